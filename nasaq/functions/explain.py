"""Which rules a key depends on."""

from __future__ import annotations

from dataclasses import replace
from functools import lru_cache

from .kernel import decomposed, nfd, normalize, touched
from .profile import Profile, resolve

MAX_BYTES = 32 * 1024
_NAMED = (("presentation forms", "presentation"), ("tashkil",) * 2, ("tatweel",) * 2, ("alef hamza", "alef_hamza"), ("alef wasla", "alef_wasla"), ("hamza seat", "hamza_seat"), ("ta marbuta", "ta_marbuta"), ("alef maksura", "alef_maksura"), ("joiners",) * 2, ("bidi controls", "bidi"), ("digits",) * 2, ("punctuation",) * 2, ("Quranic marks", "quranic"), ("rasm",) * 2)


@lru_cache(64)
def _without(profile: str, languages: str) -> tuple[Profile, list[tuple[str, Profile, frozenset[str]]]]:
    """(profile, (rule, profile without it, points without which both have the same key) of each rule)."""
    p = resolve(profile, languages)
    off = [(name, replace(p, **{field: False})) for name, field in _NAMED if getattr(p, field)]
    if p.languages:
        off.append(("language equivalences", replace(p, languages=frozenset())))
    return p, [(name, q, touched(p, q)) for name, q in off]


def explain(text: str, profile: str = "search", languages: str = "ar", most: int | None = MAX_BYTES) -> tuple[str, list[str]]:
    """(key, rules): a rule is listed if the key changes when it alone is off."""
    if most is not None and len(text.encode("utf-8")) > most:
        raise ValueError(f"text is over {most} bytes")
    p, without = _without(profile, languages)
    key = normalize(p, text)
    if text.isascii():
        return key, []
    points = set(text).union(decomposed(p, text))
    rules = ["Unicode NFD"] if nfd(text) != text else []
    return key, rules + [name for name, q, at in without if not at.isdisjoint(points) and normalize(q, text) != key]
