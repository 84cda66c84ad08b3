"""What a parts description states: maker, kind of part, build, position and two measures, in one spelling.

Sellers word the same product differently: synonyms, abbreviations, inverted names ("joint, ball"), misspelt words,
slogans, vehicles, other parts' numbers, and measures in other units.  ``Reader`` turns a description into a
``Spec``: by a lexicon of kinds where it names one of them, and else by what it says at all.

The lexicon is no closed world.  A kind's head word with a strange word right beside it ("fuel pump") is a kind of its
own, and a description without any known head word states the set of its words and the values of its measures, so its
listings still meet in any order and units.  Slogans are not listed: phrases that stand beside many different kinds are
learned from the descriptions (``learned_noise``).  The makers come from a table.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.session import Workspace, spread


class Spec(NamedTuple):
    """Null where the description is silent.  Measures are whole numbers: mm, g, ml, months, amperes or a count.
    ``open`` is what a description of a kind that is not in the lexicon states: its words and its measures."""

    maker: str | None
    kind: str | None
    build: str | None
    position: str | None
    first: int | None
    second: int | None
    replaces: list[str]
    open: str | None = None

    @property
    def positioned(self) -> bool:
        return self.kind in KINDS and KINDS[self.kind].positioned


    def full_text(self) -> str | None:
        """The specification as one text; None unless maker, kind, build, both measures and, for a kind that has one,
        the position are stated; for a kind that is not in the lexicon the maker, a word and two measures."""
        if self.open is not None and self.maker is not None:
            return f"{self.maker}|{self.position or ''}|{self.open}"
        if self.maker is None or self.kind is None or self.build is None or self.first is None or self.second is None:
            return None
        if self.position is None and self.positioned:
            return None
        return f"{self.maker}|{self.kind}|{self.build}|{self.position or ''}|{self.first}|{self.second}"


EMPTY = Spec(None, None, None, None, None, None, [])


def kind_code(kind: str | None) -> int | None:
    """A number for a kind: its place in the lexicon, or a hash beyond."""
    if kind is None:
        return None
    return _PLACES[kind] if kind in _PLACES else 1000 + (zlib.crc32(kind.encode()) >> 2)


@dataclass(frozen=True)
class Kind:
    """words: phrases that tell the kind; builds: phrases by build; first, second: unit type and labels of the
    two measures; positioned: whether it has a place on the vehicle; beside: words that may stand right beside its head
    word without making it another kind."""

    words: list[str]
    builds: dict[str, list[str]]
    first: tuple[str, list[str]]
    second: tuple[str, list[str]]
    positioned: bool = False
    beside: str = ""


#: Fixed values, in the order in which the kinds are tried: an earlier kind's words may stand in a later one's name.
KINDS = {
    "brake pads": Kind(
        ["pad", "pads"], {"ceramic": ["ceramic compound", "ceramic", "cer"], "semi-metallic": ["semi-metallic", "semi metallic", "semi met", "sm"]},
        ("mm", ["width", "wide", "w"]), ("mm", ["thickness", "thick", "thk"]), True, "brake brakes brk disc disk set",
    ),
    "water pump": Kind(
        ["w/pump", "pump", "pumps"], {"aluminum": ["aluminum", "aluminium", "alum body", "alloy", "alum"], "cast iron": ["cast iron", "ci body", "ci"]},
        ("mm", ["impeller dia", "impeller diameter", "impeller"]), ("mm", ["shaft dia", "shaft diameter", "shaft"]), False, "water coolant engine",
    ),
    "hose": Kind(
        ["hose", "hoses"], {"upper": ["upper", "upr", "top"], "lower": ["lower", "lwr", "bottom"]},
        ("mm", ["length", "long", "l"]), ("mm", ["inside dia", "inside diameter", "bore", "id"]), False, "radiator rad coolant engine",
    ),
    "ball joint": Kind(
        ["b/joint", "joint", "joints"], {"press-in": ["press-in", "press in", "press fit"], "bolt-on": ["bolt on style", "bolt-on", "bolt on"]},
        ("mm", ["stud dia", "stud diameter", "stud"]), ("mm", ["housing dia", "housing", "body dia", "body diameter", "body"]), True, "ball suspension",
    ),
    "tie rod end": Kind(
        ["tie rod", "tre"], {"greasable": ["w/grease fitting", "greaseable", "greasable"], "sealed": ["maintenance free", "sealed"]},
        ("mm", ["length", "long", "l"]), ("mm", ["taper dia", "taper diameter", "taper"]), True, "steering end outer inner",
    ),
    "hub": Kind(
        ["hub", "hubs"], {"without abs": ["without abs", "w/o abs", "non-abs", "non abs"], "with abs": ["with abs", "w/abs", "w/ abs", "abs type"]},
        ("mm", ["flange dia", "flange diameter", "flange"]), ("mm", ["pilot dia", "pilot diameter", "pilot"]), True, "wheel bearing",
    ),
    "coil spring": Kind(
        ["spring", "springs"], {"linear": ["linear rate", "std rate", "linear"], "progressive": ["progr. rate", "progr rate", "progressive"]},
        ("mm", ["free height", "free length"]), ("mm", ["wire dia", "wire diameter", "wire"]), True, "coil suspension",
    ),
    "shock": Kind(
        ["shock", "shocks", "damper", "dampers", "absorber"], {"gas": ["gas charged", "gas", "nitrogen"], "hydraulic": ["hydraulic", "oil filled", "hyd"]},
        ("mm", ["extended length", "ext length", "extended"]), ("mm", ["rod dia", "rod diameter", "rod"]), True, "shock absorber suspension",
    ),
    "oxygen sensor": Kind(
        ["sensor", "sensors", "snsr"], {"unheated": ["unheated", "no heater"], "heated": ["w/heater", "heated"]},
        ("mm", ["cable length", "lead length", "cable", "lead"]), ("count", ["wire count", "wires", "wire"]), False, "oxygen lambda",
    ),
    "starter": Kind(
        ["starter", "starters", "strtr", "starting"], {"gear reduction": ["gear reduction", "gear red.", "gear red", "pmgr"], "direct drive": ["direct drive", "dd"]},
        ("count", ["teeth", "tooth", "t"]), ("g", ["weight", "wt"]), False, "motor engine",
    ),
    "alternator": Kind(
        ["alternator", "alternators", "alt", "generator"], {"remanufactured": ["remanufactured", "reman", "rebuilt"], "new": ["brand new build", "100% new", "new unit", "new"]},
        ("amp", ["rated output", "output"]), ("mm", ["pulley dia", "pulley diameter", "pulley"]), False, "",
    ),
    "belt": Kind(
        ["belt", "belts"], {"epdm": ["epdm rubber", "epdm"], "neoprene": ["neoprene", "cr rubber"]},
        ("mm", ["eff. length", "eff length", "length", "long", "l"]), ("count", ["rib count", "ribs", "rib"]), False, "serpentine multi rib ribbed drive",
    ),
    "exhaust clamp": Kind(
        ["clamp", "clamps"], {"stainless": ["stainless steel", "stainless", "ss"], "zinc": ["zinc plated", "zinc", "zp"]},
        ("mm", ["diameter", "dia", "id"]), ("mm", ["band width", "band"]), False, "exhaust muffler",
    ),
    "battery cable": Kind(
        ["cable", "cables"], {"positive": ["positive", "pos (+)", "pos", "red"], "negative": ["negative", "neg (-)", "neg", "black"]},
        ("mm", ["length", "long", "l"]), ("count", ["gauge", "ga"]), False, "battery batt",
    ),
    "oil filter": Kind(
        ["oil filter", "lube filter", "oil fltr", "lube fltr", "filter oil", "filter lube", "filters oil"], {"spin-on": ["spin on type", "spin-on", "spin on"], "cartridge": ["cart. element", "cart element", "cartridge"]},
        ("mm", ["height", "ht", "h"]), ("mm", ["outer dia", "outer diameter", "diameter", "dia", "od"]), False, "engine oil lube",
    ),
    "air filter": Kind(
        ["air filter", "air fltr", "air cleaner", "filter air", "filters air"], {"panel": ["flat panel", "panel"], "round": ["round", "radial"]},
        ("mm", ["length", "long", "l"]), ("mm", ["height", "ht", "h"]), False, "engine air",
    ),
    "brake rotor": Kind(
        ["rotor", "rotors", "brake disc", "disc brake"], {"solid": ["solid", "sld"], "vented": ["ventilated", "vented", "vntd"]},
        ("mm", ["outer dia", "diameter", "dia", "od"]), ("mm", ["thickness", "thick", "thk"]), True, "brake brakes brk disc disk",
    ),
    "coolant": Kind(
        ["coolant", "coolants", "antifreeze"], {"concentrate": ["concentrate", "conc.", "conc"], "premixed": ["50/50 premix", "premixed", "premix", "ready to use"]},
        ("ml", ["volume", "size", "jug"]), ("month", ["service life", "life"]), False, "engine antifreeze coolant long life",
    ),
}

#: Places on the vehicle.  A side without an end is not a place of its own.
POSITIONS = {
    "left front": ["driver side front", "left front", "front left", "frt lh", "lf"],
    "right front": ["passenger side front", "right front", "front right", "frt rh", "rf"],
    "left rear": ["driver side rear", "left rear", "rear left", "rr lh", "lr"],
    "right rear": ["passenger side rear", "right rear", "rear right", "rr rh"],
    "front": ["front", "frt", "fr", "f/"],
    "rear": ["rear", "rr", "r/"],
}

#: Words that may stand beside any kind: groups of parts, and words for a part as such.
GENERAL = set("""assembly assy unit units set sets kit kits part parts type style new element the and for with without each pair pcs chassis electrical brake brakes
    cooling filters filter fluids wiring exhaust belts hoses steering suspension engine""".split())

#: Unit -> type and factor to mm, g, ml, months or amperes.
UNITS = {
    "mm": ("mm", 1.0), "cm": ("mm", 10.0), "in": ("mm", 25.4), "in.": ("mm", 25.4), "inch": ("mm", 25.4), "inches": ("mm", 25.4), '"': ("mm", 25.4),
    "g": ("g", 1.0), "kg": ("g", 1000.0), "lb": ("g", 453.59237), "lbs": ("g", 453.59237), "oz": ("g", 28.349523),
    "ml": ("ml", 1.0), "l": ("ml", 1000.0), "qt": ("ml", 946.352946), "gal": ("ml", 3785.411784),
    "mo": ("month", 1.0), "yr": ("month", 12.0), "a": ("amp", 1.0), "amp": ("amp", 1.0), "amps": ("amp", 1.0),
}
#: Measures are stated to two places at best, so a converted one is rounded to these steps.
STEPS = {"mm": 1, "g": 10, "ml": 10, "month": 1, "amp": 1, "count": 1}

_VEHICLE = re.compile(r"\bfits\b.{1,40}?\b\d{2,4}\s*(?:-|–|thru|to)\s*\d{2,4}\b")
_REFERENCE = re.compile(r"\b(repl(?:aces)?\b|xref\b|supersedes\b|oe#|\(?mfr no\b|req\b|requires\b|use w/|used with\b|sold with\b)[.:\s#]*")
_SAME_PART = ("repl", "xref", "supersedes", "oe#", "mfr no")
_NUMBER_END = re.compile(r"[a-z0-9][a-z0-9 ./–-]*")
_WORD = re.compile(r"[a-z]{4,}")
_TOKEN = re.compile(r"[^\s,;|:=]+")
_REFERRING = {"repl", "replaces", "xref", "oe#", "mfr", "req", "use", "used", "sold", "supersedes", "requires"}


def _tokens(text: str) -> list[str]:
    return [t.rstrip(".") for t in _TOKEN.findall(text)]


def clean(number: str) -> str:
    return re.sub("[^A-Z0-9]", "", number.upper())


def _either(phrases: Iterable[str]) -> str:
    return "|".join(re.escape(p) for p in sorted(phrases, key=len, reverse=True))


def _scanner(kind: Kind) -> re.Pattern:
    units = _either(UNITS)
    return re.compile(
        rf"(?<![\w.#/])(?P<n>\d+(?:\.\d+)?)\s*(?P<u>{units})?(?![a-z0-9%/])"
        rf"|(?<![a-z0-9/])(?:(?P<a>{_either(kind.first[1])})|(?P<b>{_either(kind.second[1])}))(?![a-z])"
    )


_NAMES = list(KINDS)
_PLACES = {name: i for i, name in enumerate(_NAMES)}
_SCANS = {name: _scanner(k) for name, k in KINDS.items()}


def read_measures(kind: str, text: str) -> tuple[int | None, int | None]:
    """The two measures of a kind of part.  A number belongs to the label right before or after it; where both are
    labels, to the one joined by a colon or equals sign, else to the one that no other number can have."""
    spec = KINDS[kind]
    types = (spec.first[0], spec.second[0])
    items = []
    for m in _SCANS[kind].finditer(text):
        if m["n"]:
            unit = m["u"]
            t, factor = UNITS[unit] if unit else ("count", 1.0)
            if t not in types:
                if unit in ("l", "a", "g") and "count" in types:
                    t, factor = "count", 1.0  # "4 L ..." where L is a label
                else:
                    continue
            items.append([m.start(), m.start() + len(m["n"]) if unit in ("l", "a", "g") and t == "count" else m.end(), t, float(m["n"]) * factor])
        else:
            items.append([m.start(), m.end(), 0 if m["a"] else 1, None])
    owner: dict[int, int] = {}
    choices: dict[int, list[int]] = {}
    for i, (start, end, t, value) in enumerate(items):
        if value is None:
            continue
        own = []
        if i and items[i - 1][3] is None and types[items[i - 1][2]] == t:
            gap = text[items[i - 1][1] : start].strip(" ")
            if gap in (":", "="):
                owner[i] = i - 1
                continue
            if not gap:
                own.append(i - 1)
        if i + 1 < len(items) and items[i + 1][3] is None and types[items[i + 1][2]] == t and not text[end : items[i + 1][0]].strip(" "):
            own.append(i + 1)
        choices[i] = own
    changed = True
    while changed:
        changed = False
        taken = set(owner.values())
        for i, own in choices.items():
            if i not in owner and len(left := [j for j in own if j not in taken]) == 1:
                owner[i] = left[0]
                taken.add(left[0])
                changed = True
    for i, own in choices.items():
        taken = set(owner.values())
        if i not in owner and (left := [j for j in own if j not in taken]):
            owner[i] = left[-1]
    found: list[int | None] = [None, None]
    for i, j in sorted(owner.items()):
        slot = items[j][2]
        if found[slot] is None:
            found[slot] = _rounded(items[i][3], types[slot])
    for i in choices:  # a number whose unit only one of the measures can have needs no label
        t = items[i][2]
        if i not in owner and t != "count" and types.count(t) == 1 and found[types.index(t)] is None:
            found[types.index(t)] = _rounded(items[i][3], t)
    return found[0], found[1]


def _rounded(value: float, unit_type: str) -> int:
    step = STEPS[unit_type]
    return int(value / step + 0.5) * step


class Reader:
    """Reads descriptions; knows the makers by name, and by the first word of a name of several words if no other
    maker's name begins with it."""

    def __init__(self, makers: Iterable[str], noise: Iterable[str] = ()):
        names = {re.sub(r"\s+", " ", m.strip().lower()) for m in makers if m and m.strip()}
        firsts: dict[str, set[str]] = {}
        for n in names:
            firsts.setdefault(n.split(" ")[0], set()).add(n)
        makers = {n: n for n in names} | {f: next(iter(own)) for f, own in firsts.items() if len(own) == 1 and len(f) > 3}
        self.phrases: dict[str, list[tuple[tuple[str, ...], list[tuple[str, str, int]]]]] = {}
        meanings: dict[tuple[str, ...], list[tuple[str, str, int]]] = {}
        texts: list[str] = []

        def add(phrase: str, what: str, value: str, index: int = 0) -> None:
            meanings.setdefault(tuple(_tokens(phrase)), []).append((what, value, index))
            texts.append(phrase)

        for phrase, value in makers.items():
            add(phrase, "maker", value)
        noise = set(noise)
        for phrase in noise:
            if " " in phrase:
                add(phrase, "noise", "")
        for value, own in POSITIONS.items():
            for phrase in own:
                add(phrase, "position", value)
        for i, (name, k) in enumerate(KINDS.items()):
            for phrase in k.words:
                add(phrase, "kind", name, i)
            for value, own in k.builds.items():
                for phrase in own:
                    add(phrase, "build", value, i)
            texts += [*k.first[1], *k.second[1]]
        for tokens, own in meanings.items():
            self.phrases.setdefault(tokens[0], []).append((tokens, own))
        for own in self.phrases.values():
            own.sort(key=lambda x: -len(x[0]))
        texts += ["battery batt exhaust muffler radiator engine serpentine multi bearing wheel assembly unit suspension steering element"]
        texts += ["lambda oxygen brake brakes cleaner chassis electrical fits thru replaces sold with xref cooling filter filters fluids wiring"]
        words = {w for text in texts for w in re.findall("[a-z]{3,}", text)}
        self.words = frozenset(words)
        self.fine: set[str] = set()
        units = {u for u in UNITS if u.isalpha()}
        self.neutral = GENERAL | units | {w for phrase in (*makers, *noise, *(x for own in POSITIONS.values() for x in own)) for w in _tokens(phrase)}
        self.beside = [
            set(k.beside.split()) | {w for x in (*k.words, *k.first[1], *k.second[1], *(y for own in k.builds.values() for y in own)) for w in _tokens(x)} for k in KINDS.values()
        ]
        self.near: dict[str, set[str]] = {}
        for w in words:
            if len(w) >= 4:
                for form in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
                    self.near.setdefault(form, set()).add(w)
        self.mended: dict[str, str] = {}

    def _mend(self, m: re.Match) -> str:
        """A word that is not known but one letter away from a known word (or two letters swapped); of several such
        words the longest, and none if that leaves a choice."""
        w = m[0]
        if w in self.words or w in self.fine:
            return w
        known = self.mended.get(w)
        if known is None:
            forms = {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}
            hits = {v for f in forms for v in self.near.get(f, ()) if _one_edit(w, v)}
            longest = [v for v in hits if len(v) == max(map(len, hits))]
            known = longest[0] if len(longest) == 1 else w
            if len(self.mended) + len(self.fine) > 100_000:
                self.mended, self.fine = {}, set()
            if known == w:
                self.fine.add(w)
            else:
                self.mended[w] = known
        return known

    def read(self, description: str | None) -> Spec:
        """A null, empty or unknown description states nothing."""
        if not description:
            return EMPTY
        s = html.unescape(description) if "&" in description else description
        if not s.isascii():
            s = unicodedata.normalize("NFKC", s)
        s = " ".join(s.replace("_", " ").lower().split())
        if "fits" in s:
            s = _VEHICLE.sub(" | ", s)
        if any(w not in self.words and w not in self.fine for w in _WORD.findall(s)):
            s = _WORD.sub(self._mend, s)
        tokens = _tokens(s)
        replaces: list[str] = []
        if not _REFERRING.isdisjoint(tokens) or "(mfr" in s:
            s, replaces = _references(s)
            tokens = _tokens(s)
        maker = position = None
        best, builds, heads, said = len(_NAMES), [], [], []
        i, n = 0, len(tokens)
        phrases = self.phrases
        while i < n:
            own = phrases.get(tokens[i])
            step = 1
            if own is not None:
                for phrase, means in own:
                    size = len(phrase)
                    if size == 1 or tuple(tokens[i : i + size]) == phrase:
                        step = size
                        if all(what in ("kind", "build") for what, _, _ in means):
                            said += phrase
                        for what, value, index in means:
                            if what == "kind":
                                best = min(best, index)
                                heads.append((index, i, step))
                            elif what == "build":
                                builds.append((index, value))
                            elif what == "maker":
                                maker = maker or value
                            elif what == "position":
                                position = position or value
                        break
                else:
                    said.append(tokens[i])
            else:
                said.append(tokens[i])
            i += step
        if best == len(_NAMES):
            return Spec(maker, None, None, position, None, None, replaces, self._open(said, s))
        strange = [self._strange(best, tokens, i, step, s) for index, i, step in heads if index == best]
        if all(strange):
            head = next(" ".join(tokens[i : i + step]) for index, i, step in heads if index == best)
            return Spec(maker, f"{strange[0]} {head}", None, position, None, None, replaces, self._open([*said, head], s))
        kind = _NAMES[best]
        build = next((value for index, value in builds if index == best), None)
        first, second = read_measures(kind, s) if any(map(str.isdigit, s)) else (None, None)
        return Spec(maker, kind, build, position if KINDS[kind].positioned else None, first, second, replaces)


    def _strange(self, kind: int, tokens: list[str], i: int, step: int, s: str) -> str | None:
        """A word right before the head word of a kind, or alone between commas right after it, that makes it another
        kind of part."""
        if i and _OWN_WORD.fullmatch(w := tokens[i - 1]) and w not in self.beside[kind] and w not in self.neutral and f"{w} {tokens[i]}" in s:
            return w
        if i + step < len(tokens) and _OWN_WORD.fullmatch(w := tokens[i + step]) and w not in self.beside[kind] and w not in self.neutral:
            at = s.find(f"{tokens[i + step - 1]}, {w}")
            if at >= 0 and _SEGMENT_END.match(s, at + len(tokens[i + step - 1]) + 2 + len(w)):
                return w
        return None

    def _open(self, said: list[str], s: str) -> str | None:
        """Words and labelled measures of a description whose kind is not in the lexicon; None without a word or with
        fewer than two measures that have a unit.  A measure belongs to the word joined to it by a colon or equals sign,
        else to a word right beside it; where one stands on either side, to the one after it if the last measure has
        one there, else to the one before it."""
        found = list(_MEASURE.finditer(s))
        words = {w for w in said if _OWN_WORD.fullmatch(w) and w not in self.neutral}
        if not words or len(found) < 2:
            return None
        label = lambda w: w[1] if w and w[1] in words else None
        before = [_LABEL_BEFORE.search(s, 0, m.start()) for m in found]
        after = [label(_LABEL_AFTER.match(s, m.end())) for m in found]
        values = []
        for m, b, a in zip(found, before, after):
            t, factor = UNITS[m["u"]]
            first = b is not None and b[2] or after[-1] is None or a is None
            values.append(f"{(label(b) or a if first else a) or ''}={_rounded(float(m['n']) * factor, t)}{t}")
        return f"{' '.join(sorted(words))}|{' '.join(sorted(values))}"


_LABEL_BEFORE = re.compile(r"([a-z]{3,})\s*([:=])?\s*$")
_LABEL_AFTER = re.compile(r"\s*([a-z]{3,})")
_OWN_WORD = re.compile(r"[a-z]{3,}")
_SEGMENT_END = re.compile(r"\s*(?:[,;|]|$)")
_MEASURE = re.compile(rf"(?<![\w.#/])(?P<n>\d+(?:\.\d+)?)\s*(?P<u>{_either(UNITS)})(?![a-z0-9%/])")

#: A phrase that stands beside at least so many kinds of part, at most three words long, says nothing about the part.
NOISE_KINDS, NOISE_WORDS = 5, 3
#: A phrase must make up this share of the uses of its rarest word, and be in so large a share of all descriptions;
#: as a description has few phrases, the second bounds their number.
NOISE_COHESION, NOISE_LEAST = 0.5, 1 / 5000


def learned_noise(rows: DataFrame, makers: Iterable[str]) -> list[str]:
    """Phrases of the descriptions (slogans, packing, remarks) that say nothing about a part, as they stand beside
    parts of many kinds.  Counted over all rows, added up before the shuffle."""
    makers = list(makers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {w for m in makers for w in _tokens(m.lower())} | {w for p in POSITIONS.values() for x in p for w in _tokens(x)}
        heads = {_tokens(x)[-1]: 1 << i for i, k in enumerate(KINDS.values()) for x in k.words}
        known = own | set(heads)
        for batch in batches:
            count: Counter[str] = Counter()
            kinds: dict[str, int] = {}
            for text in batch.column(0).to_pylist():
                every = _tokens(text.lower().replace("_", " "))
                tokens = [t if _PLAIN.fullmatch(t) and t not in known and not (t in UNITS and k and every[k - 1][-1].isdigit()) else None for k, t in enumerate(every)]
                kind = next((heads[t] for t in every if t in heads), 0)
                grams = {" ".join(tokens[i : i + n]) for n in range(1, NOISE_WORDS + 1) for i in range(len(tokens) - n + 1) if None not in tokens[i : i + n]}
                for g in grams:
                    kinds[g] = kinds.get(g, 0) | kind
                count.update(grams)
                count[""] += 1
            names = list(count)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([count[g] for g in names], pa.int64()), pa.array([kinds.get(g, 0) for g in names], pa.int64())], names=["phrase", "n", "kinds"])

    parts = spread(rows.select("description").filter("description is not null")).mapInArrow(run, "phrase string, n bigint, kinds bigint")
    counts = Workspace(rows.sparkSession, "noise").save(parts.groupBy("phrase").agg(F.sum("n").alias("n"), F.bit_or("kinds").alias("kinds")), "counts")
    total = counts.filter("phrase = ''").agg(F.sum("n").alias("n")).first()["n"] or 0
    kept = counts.filter((F.col("phrase") != "") & (F.col("n") >= max(3.0, total * NOISE_LEAST)) & (F.bit_count("kinds") >= NOISE_KINDS))
    found = {r["phrase"]: r["n"] for r in kept.select("phrase", "n").collect()}  # at most NOISE_WORDS / NOISE_LEAST times the words of a description
    return sorted(g for g, n in found.items() if all(w in found and n >= NOISE_COHESION * found[w] for w in [min(g.split(" "), key=lambda w: found.get(w, 0))]))


_PLAIN = re.compile(r"[a-z#*!][a-z*!'-]*\d*")


def _references(s: str) -> tuple[str, list[str]]:
    """The text before the first mention of another number, and the numbers said to be the same part's."""
    m = _REFERENCE.search(s)
    if not m:
        return s, []
    tail, found = s[m.start() :], []
    marks = list(_REFERENCE.finditer(tail))
    for i, mark in enumerate(marks):
        if mark[1].lstrip("(").startswith(_SAME_PART):
            piece = _NUMBER_END.match(tail, mark.end(), marks[i + 1].start() if i + 1 < len(marks) else len(tail))
            number = clean(piece[0]) if piece else ""
            if 4 <= len(number) <= 16 and any(c.isdigit() for c in number):
                found.append(number)
    return s[: m.start()], found


def _one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion or swap of neighbours, or in a word of six letters or more one change, turns a
    into b.  Short words that differ by a letter are too often two words."""
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return (len(a) > 5 and a[i + 1 :] == b[i + 1 :]) or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :]
