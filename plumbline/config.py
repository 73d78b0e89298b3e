"""What a report is about: entities, questions, owned sites. Small driver-side values, strictly checked.

Parsed from YAML or JSON, frozen, and hashed in a canonical form, so that a change of wording, intent or version shows
and a change of key order doesn't.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from pathlib import Path

from plumbline.operators.mentions import Entity

SCHEMA = 1
MOST_REPEATS = 50
#: platforms that a run may ask; payloads of others can still be parsed
ENGINES = ("anthropic", "openai", "google")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Question:
    index: int
    text: str
    intent: str


@dataclass(frozen=True)
class Config:
    entities: tuple[Entity, ...]  # the brand comes first
    owned: tuple[str, ...]
    questions: tuple[Question, ...]
    recommendation: tuple[str, ...]
    engines: tuple[str, ...]
    repeats: int
    version: int

    @property
    def brand(self) -> Entity:
        return self.entities[0]

    def recommending(self) -> tuple[int, ...]:
        return tuple(q.index for q in self.questions if q.intent in self.recommendation)

    def warnings(self) -> list[str]:
        out = []
        if not self.recommending():
            out.append("no question has a recommendation intent: that rate is not measured")
        if not self.owned:
            out.append("no owned site is named: citations of owned sites are not measured")
        return out

    def prompt_set_hash(self) -> str:
        asked = [{"text": q.text, "intent": q.intent} for q in self.questions]
        return "sha256:" + digest({"version": self.version, "questions": asked, "recommendation": sorted(self.recommendation)})


def canonical(value: object) -> str:
    """One text for equal values: keys sorted, no blanks, letters as they are."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def digest(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def bare_host(site: str) -> str:
    host = site.strip().lower().split("://", 1)[-1]
    for end in "/?#":
        host = host.split(end, 1)[0]
    host = host.split(":", 1)[0].removeprefix("www.")
    if not host:
        raise ConfigError("an owned site is blank")
    return host


def _fields(doc: dict, where: str, required: set[str], optional: set[str] = frozenset()) -> dict:
    if not isinstance(doc, dict):
        raise ConfigError(f"{where}: an object is expected")
    if unknown := set(doc) - required - optional:
        raise ConfigError(f"{where}: unknown {', '.join(sorted(unknown))}")
    if lacking := required - set(doc):
        raise ConfigError(f"{where}: {', '.join(sorted(lacking))} missing")
    return doc


def _text(value: object, where: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ConfigError(f"{where} is blank")
    return value


def _entity(doc: dict, role: str) -> Entity:
    d = _fields(doc, role, {"name"}, {"aliases", "owned_domains"} if role == "brand" else {"aliases"})
    return Entity(_text(d["name"], f"{role} name"), role, tuple(_text(a, "an alias").strip() for a in d.get("aliases") or ()))


def _unique(values: list, what: str) -> None:
    if len(set(values)) != len(values):
        raise ConfigError(f"{what} must differ")


def parse(doc: dict) -> Config:
    d = _fields(doc, "config", {"schema", "brand", "engines", "repeats", "prompt_set"}, {"competitors", "recommendation_intents"})
    if d["schema"] != SCHEMA:
        raise ConfigError(f"schema must be {SCHEMA}")
    entities = (_entity(d["brand"], "brand"), *(_entity(c, "competitor") for c in d.get("competitors") or ()))
    _unique([e.name for e in entities], "names of brand and competitors")
    prompts = _fields(d["prompt_set"], "prompt_set", {"version", "queries"})
    questions = tuple(Question(i, _text(q["text"], "a question"), _text(q["intent"], "an intent")) for i, q in enumerate(_fields(x, "query", {"text", "intent"}) for x in prompts["queries"] or ()))
    _unique([q.text for q in questions], "questions")
    engines = tuple(d["engines"] or ())
    _unique(list(engines), "engines")
    if unknown := set(engines) - set(ENGINES):
        raise ConfigError(f"unsupported engines: {', '.join(sorted(unknown))}")
    if not questions or not engines:
        raise ConfigError("at least one question and one engine are needed")
    for name, value, most in (("repeats", d["repeats"], MOST_REPEATS), ("version", prompts["version"], None)):
        if not isinstance(value, int) or isinstance(value, bool) or value < 1 or most and value > most:
            raise ConfigError(f"{name} must be a whole number from 1" + (f" to {most}" if most else ""))
    owned = tuple(dict.fromkeys(map(bare_host, d["brand"].get("owned_domains") or ())))
    return Config(entities, owned, questions, tuple(d.get("recommendation_intents") or ("recommendation",)), engines, d["repeats"], prompts["version"])


def selected_engines(config: Config, requested: str | None) -> tuple[str, ...]:
    """The engines of a list with commas in order of the configuration; all without a list."""
    if not requested:
        return config.engines
    names = {n.strip() for n in requested.split(",") if n.strip()}
    if unknown := names - set(config.engines):
        raise ConfigError(f"not configured: {', '.join(sorted(unknown))}")
    return tuple(e for e in config.engines if e in names)


def load(path: str | Path) -> Config:
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith((".yaml", ".yml")):
        import yaml  # optional: JSON needs nothing

        return parse(yaml.safe_load(text))
    return parse(json.loads(text))
