"""What a comparison key ignores: profiles, their presets and languages."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

LANGUAGES = ("ar", "fa", "ur", "ps", "ku", "ug")
#: Which marks count as vowel signs: every nonspacing mark, the eight harakat, or those and the dagger alef.
SCOPES = ("all", "harakat", "harakat+dagger")


def parse_languages(names: str) -> frozenset[str]:
    """Languages of a comma-separated list; an empty or unknown item is an error."""
    out = set()
    for item in names.split(","):
        if (name := item.strip()) not in LANGUAGES:
            raise ValueError(f"unknown language {name!r}; choose from {', '.join(LANGUAGES)}")
        out.add(name)
    return frozenset(out)


def format_languages(languages: frozenset[str]) -> str:
    """A comma-separated list in a fixed order."""
    return ",".join(x for x in LANGUAGES if x in languages)


@dataclass(frozen=True)
class Profile:
    """One switch per rule; the default one decomposes and changes nothing else."""

    scope: str = "all"
    tashkil: bool = False
    tatweel: bool = False
    alef_hamza: bool = False
    alef_wasla: bool = False
    hamza_seat: bool = False
    ta_marbuta: bool = False
    alef_maksura: bool = False
    presentation: bool = False
    joiners: bool = False
    bidi: bool = False
    quranic: bool = False
    digits: bool = False
    punctuation: bool = False
    rasm: bool = False
    languages: frozenset[str] = frozenset()

    def __post_init__(self):
        if self.scope not in SCOPES:
            raise ValueError(f"unknown scope of vowel signs {self.scope!r}")
        if bad := set(self.languages) - set(LANGUAGES):
            raise ValueError(f"unknown languages {sorted(bad)}")

    @property
    def keeps_zwnj(self) -> bool:
        """ZWNJ is spelling, not layout, in Persian, Sorani and Uyghur."""
        return bool(self.languages & {"fa", "ku", "ug"})

    @property
    def crosses_arabic(self) -> bool:
        return "ar" in self.languages and len(self.languages) > 1


_AR = frozenset({"ar"})
_STRICT = Profile(tashkil=True, tatweel=True, presentation=True, joiners=True, bidi=True, quranic=True, languages=_AR)
_SEARCH = replace(_STRICT, alef_hamza=True, alef_wasla=True, hamza_seat=True, ta_marbuta=True, alef_maksura=True)
PROFILES = {
    "search": _SEARCH,
    "strict": _STRICT,
    "loose": replace(_SEARCH, digits=True, punctuation=True, rasm=True),
    "lucene": Profile(scope="harakat", tashkil=True, tatweel=True, alef_hamza=True, ta_marbuta=True, alef_maksura=True, languages=_AR),
    "camel": Profile(scope="harakat+dagger", tashkil=True, alef_hamza=True, alef_wasla=True, ta_marbuta=True, alef_maksura=True, languages=_AR),
}

#: What each override sets, on top of a preset.
OVERRIDES = {
    "keep_hamza": {"alef_hamza": False, "alef_wasla": False, "hamza_seat": False},
    "keep_tamarbuta": {"ta_marbuta": False},
    "keep_tashkil": {"tashkil": False},
    "keep_presentation_forms": {"presentation": False},
    "keep_joiners": {"joiners": False},
    "keep_bidi_marks": {"bidi": False},
    "keep_quranic_marks": {"quranic": False},
    "fold_digits": {"digits": True},
    "fold_punctuation": {"punctuation": True},
    "rasm": {"rasm": True},
}


def resolve(name: str = "search", languages: str | frozenset[str] = "ar", overrides: tuple[str, ...] = ()) -> Profile:
    """A preset with overrides applied, then its languages replaced."""
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; choose from {', '.join(PROFILES)}")
    p = PROFILES[name]
    for o in overrides:
        if o not in OVERRIDES:
            raise ValueError(f"unknown override {o!r}")
        p = replace(p, **OVERRIDES[o])
    return replace(p, languages=parse_languages(languages) if isinstance(languages, str) else frozenset(languages))


SWITCHES = tuple(f.name for f in fields(Profile) if f.name not in ("scope", "languages"))
