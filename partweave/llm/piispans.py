"""Candidate places of personal information in a text, and what each labeler says about them.

A candidate is a stretch of text that might be an e-mail address, a phone number, an identity number, a street
address or a person's name.  Patterns are generous; labelers (patterns, gazetteers, context) then vote for, against or
not at all.  Which labelers are to be believed is learned elsewhere (partweave.llm.pii)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from typing import NamedTuple

KINDS = ["email", "phone", "id_number", "address", "name"]

#: Hashed features of the span classifier; a power of two, so weights have a fixed size.
DIMENSIONS = 1 << 16
#: Share, of 255, of lower-case uses from which a word counts as ordinary.
ORDINARY = 64


class Candidate(NamedTuple):
    kind: int
    start: int
    end: int
    votes: str  # one character a labeler: + for, - against, 0 none
    features: list[int]


# ---------------------------------------------------------------- fixed values

_DOT = r"(?:\s*[\[({<]\s*dot\s*[\])}>]\s*|\s+dot\s+|\.)"
EMAIL = re.compile(r"(?<![\w.+%-])[\w+%-][\w.+%-]*@\w[\w-]*(?:\.\w[\w-]*)+")
#: Written out for people: "at" in brackets, or "at" and "dot" as words.
EMAIL_SPELLED = re.compile(
    rf"(?<![\w.+%-])[\w+%-][\w.+%-]*(?:\s*[\[({{<]\s*at\s*[\])}}>]\s*\w[\w-]*(?:{_DOT}\w[\w-]*)+|\s+at\s+\w[\w-]*(?:\s+dot\s+\w[\w-]*)+)", re.I
)
PHONE = re.compile(
    r"(?<![\w.,$€/-])(?:(?:\+[  ]?\d{1,3}[  .-]?)?(?:\(\d{2,4}\)[  ./-]{0,2}|\d{1,4}[  ./-]{1,2})\d{2,8}(?:[  ./-]{1,2}\d{2,8}){0,4}|\+\d{8,13}|1?\d{10})"
    r"(?:[  ]?(?:x|ext\.?)[  ]?\d{1,5})?(?![\w$€]|[-./]\d)"
)
EXTENSION = re.compile(r"\s?(?:x|ext\.?)\s?\d{1,5}$")
NANP = re.compile(r"(?:\+?1[\s./-]?)?(?:\(\d{3}\)[\s./-]?|\d{3}[\s./-])\d{3}[\s.-]\d{4}|\+?1?[2-9]\d{2}[2-9]\d{6}")
OTHER_PHONE = re.compile(r"0\d(?:[.\s]\d{2}){4}|0\d{2,4}[/\s-]\d{5,9}|\+\d{2}[\s\d.()/-]{8,16}")
SSN = re.compile(r"\d{3}([-\s])\d{2}\1\d{4}")
ID_NUMBER = re.compile(
    r"(?<![\w.,$€/-])(?:\d{3}[-\s]\d{2}[-\s]\d{4}|[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]{1,2}\d{7}|\d{2}\.\d{3}\.\d{3}-[A-Z]|\d{8}-?[A-Z]|\d{2}-\d{7})(?![\w]|[-./]\w)"
)
_STREET = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Way|Place|Pl|Terrace|Ter|Circle|Cir|Highway|Hwy|Parkway|Pkwy|Square|Sq|Trail)"
_CAP = r"[A-ZÀ-Þ][\w'’.-]*"
ADDRESS_EN = re.compile(rf"(?<![\w.,$€#/-])\d{{1,6}}[A-Za-z]?[ \u00a0]+(?:(?:N|S|E|W|NE|NW|SE|SW|North|South|East|West)\.?[ \u00a0]+)?(?:{_CAP}[ \u00a0]+){{1,4}}?(?i:{_STREET})\b")
ADDRESS_DE = re.compile(r"(?<!\w)[A-ZÄÖÜ][\wäöüß-]*(?i:gasse|straße|strasse|str\.|weg|platz|allee|ring|damm|ufer|steig|graben|chaussee)[ \u00a0]+\d{1,4}[ \u00a0]?[a-z]?\b")
ADDRESS_FR = re.compile(
    rf"(?<![\w.,$€#/-])\d{{1,5}}(?:[ \u00a0]?(?:bis|ter))?,?[ \u00a0]+(?i:rue|avenue|boulevard|impasse|allée|place|chemin|route|quai|cours|square|ruelle)[ \u00a0]+(?:(?:de[ \u00a0]+la|du|des|de|d'|d’|l'|la|le|les)[ \u00a0]*)?{_CAP}(?:[ \u00a0]+{_CAP})*"
)
ADDRESS_ES = re.compile(rf"(?<!\w)(?i:calle|c/|avenida|avda\.?|plaza|paseo|camino|ronda|travesía|carretera)[ \u00a0]+(?:(?:de[ \u00a0]+la|del|de[ \u00a0]+los|de|la|el|los|las)[ \u00a0]+)?(?:{_CAP}[ \u00a0]+){{1,4}}?(?:n\.?º[ \u00a0]*)?\d{{1,4}}\b")
TITLES = {
    "mr", "mrs", "ms", "miss", "mx", "dr", "prof", "sr", "sra", "srta", "don", "doña", "señor", "señora", "herr", "frau", "mme", "mlle", "monsieur", "madame", "m",
}
#: Function words of English, German, French and Spanish, days and months; none is part of a name.
COMMON = set(
    """the a an and or of for to from in on at by with we they it this that these those there here no not if is are was were be been our your their his her its
    i he she you who what which when where why how would does do did can could should will may must has have had as but so than then also all any each every some
    after before between during about over under into out up down off per via re please dear hello hi thanks thank regards sincerely best yours
    monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december
    der die das den dem des ein eine einen einem einer und oder nicht ist sind war für von zu zum zur mit bei auf aus nach wenn dass bitte
    le la les l un une des du de et ou est sont pour avec sans dans sur à au aux en par que qui
    el los las lo una unos unas y o es son para con sin sobre del al por se que""".split()
)
#: Of these the ones that no name holds, however it is written.
NEVER = set("""the a an and or of for to from in on at by with this that these those is are was were be not if then but der die das den dem des ein eine und oder für von zu zum zur
    le la les un une des du et ou pour avec el los las una y para con del al""".split())
#: Words that announce a person, before the name, and words that follow one who is to be reached.
BEFORE_NAME = set(
    """customer client cliente kunde kundin driver contact kontakt contacto attn attention dear signed sincerely regards thanks yours holder owner passenger patient
    employee name nombre nom recipient hd""".split()
)
NAME_BEFORE = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(BEFORE_NAME, key=len, reverse=True))}|from:|--)\s*[:,.]?\s*$", re.I)
NAME_AFTER = re.compile(r"\s*,?\s*(?:call\b|calls\b|called\b|tel\b|tél\b|fax\b|phone\b|mobile\b|cell\b|e-?mail\b|ssn\b|licen[cs]e\b|passport\b|dl\b|id\b)", re.I)
#: A number, a part or an article beside it tells that a capitalised phrase is a thing.
THING_AFTER = re.compile(r"\s*(?:\d|[-–]|(?:brand|kit|list|stock|display|notice|pn|p/n)\b)", re.I)
THING_BEFORE = re.compile(r"(?:\b(?:the|this|that|brand|fits|maker|make|model|der|die|das|le|la|les|el|los|las)|\d)\s*:?\s*$", re.I)
PHONE_BEFORE = re.compile(r"\b(?:phone|ph|tel|tél|telephone|teléfono|telefon|téléphone|fax|call|cell|mobile|móvil|handy|reach)\b[.:]?\s*[(]?\s*$", re.I)
PART_BEFORE = re.compile(r"(?:p/n|pn|part|parts|no\.|nr\.?|n\.º|lot|ref|sku|order|invoice|code|código|batch|bin|teil|pièce|pieza|item|serial|\$|€|#)\s*[:#]?\s*$", re.I)
PART_AFTER = re.compile(r"[ \u00a0]*(?:mm|cm|kg|in|lb|ft|pcs|ea)\b|[ \u00a0]*[%$€]", re.I)
ID_BEFORE = re.compile(
    r"(?:ssn|social(?:\s+security)?(?:\s+(?:number|no\.?))?|passport|reisepass|pasaporte|passeport|licen[cs]e|dl|national\s+id|id\s+card|identity\s+(?:card|no\.?)|ausweis|dni|nie|personalausweis)\s*(?:no\.?|number|nr\.?|n\.º|#)?\s*[:#]?\s*$",
    re.I,
)
ADDRESS_BEFORE = re.compile(r"(?:home|deliver\s+to|ship\s+to|lives\s+at|address:?|livrer\s+au|adresse:?|lieferung\s+an|enviar\s+a|dirección:?)\s*$", re.I)
ADDRESS_AFTER = re.compile(r"\s*\.?,?\s*(?:apt|ste|suite|unit|#\s?\d|[A-Z][\w ]+,\s*[A-Z]{2}\s+\d{5}|\d{4,5}\s+[A-Z])", re.I)
NO_ADDRESS_BEFORE = re.compile(r"(?:bin|page|bay|aisle|line|invoice|order|lot|no\.|ref|qty|\$|€|#)\s*$", re.I)

_NAME_WORD = r"(?:[A-ZÀ-Þ][a-zà-ÿ]+(?:[A-Z][a-zà-ÿ]+)?|[A-Z]['’][A-ZÀ-Þ]?[a-zà-ÿ]+|[A-ZÀ-Þ]['’]?[A-ZÀ-Þ]{2,})(?:-[A-ZÀ-Þ][A-Za-zà-ÿ]+)?"
_PIECE = re.compile(rf"(?<![\w@.+'’/-]){_NAME_WORD}(?![\w@]|[-.'’]\w*@)|(?<![\w@.'’-])[A-ZÀ-Þ]\.(?![\w.])|(?<=/){_NAME_WORD}(?!\w)")
_GAP = re.compile(r"[ \u00a0]")
_AROUND = re.compile(r"[^\W_]+|[^\w\s]")


#: Patterns of addresses, and letters without which a text (in lower case) holds none.
_ADDRESSES = [
    ("en", ADDRESS_EN, ()),
    ("de", ADDRESS_DE, ("gasse", "straße", "strasse", "str.", "weg", "platz", "allee", "ring", "damm", "ufer", "steig", "graben", "chaussee")),
    ("fr", ADDRESS_FR, ("rue", "avenue", "boulevard", "impasse", "allée", "place", "chemin", "route", "quai", "cours", "square")),
    ("es", ADDRESS_ES, ("calle", "c/", "avenida", "avda", "plaza", "paseo", "camino", "ronda", "travesía", "carretera")),
]
#: What every spelled-out address holds: the word dot, or an at after an opening bracket.
_SPELLED_HINT = re.compile(r"dot|[\[({<]\s*at", re.I)


def _shape(text: str) -> str:
    return _LETTERS.sub("a", _CAPITALS.sub("A", _DIGITS.sub("9", text[:24])))


_DIGITS, _CAPITALS, _LETTERS = re.compile(r"\d"), re.compile(r"[A-ZÀ-Þ]+"), re.compile(r"[^\W\dA_]+")

#: Buckets of the table of word case; a power of two, so what is broadcast has a fixed size (a byte each).
CASE_BUCKETS = 1 << 20
_CASED = re.compile(r"(?<![\w@.'’-])[^\W\d_]{2,}(?![\w@]|[.'’-]\w)")
_AFTER_ARTICLE = re.compile(r"(?<!\w)(?:[Tt]he|[Tt]his|[Ff]its|[Dd]er|[Dd]ie|[Dd]as|[Ll]e|[Ll]a|[Ee]l)\s+([A-ZÀ-Þ][^\W\d_]+)(?:[ \u00a0]([A-ZÀ-Þ][^\W\d_]+))?(?!\w)")


def word_bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & (CASE_BUCKETS - 1)


def cased_words(text: str) -> list[str]:
    """The words of a text that stand free, in the case in which they stand."""
    return _CASED.findall(text)


def _shouting(line: str) -> bool:
    """Whether a line of more than six words is mostly in capitals."""
    words = re.findall(r"[^\W\d_]{2,}", line)
    return len(words) > 6 and sum(map(str.isupper, words)) > 0.6 * len(words)


def words_after_articles(text: str) -> list[str]:
    """The capitalised words, two at most in a row, that stand right after an article, as the names of things do."""
    return [w for m in _AFTER_ARTICLE.finditer(text) for w in m.groups() if w]


class Labelers:
    """Finds candidates and votes.  given, family: the known names; makers: names of makers, all lower case;
    case: for each bucket of words how often, of 255, the corpus writes them in lower case; things: how often, of their
    capitalised uses, they follow an article (None: nothing known)."""

    def __init__(self, given: Iterable[str], family: Iterable[str], makers: Iterable[str], case: bytes | None = None, things: bytes | None = None):
        self.given, self.family = set(given), set(family)
        self.makers = {w for m in makers for w in re.findall(r"[\w]+", m) if len(w) > 3}
        self.full_makers = set(makers)
        self.case, self.things = case, things
        self.codes: dict[tuple, int] = {}
        self.lower: dict[str, bool] = {}

    def ordinary(self, word: str) -> bool:
        """Whether the corpus often writes a word (given in lower case) in lower case: then it is hardly a name."""
        known = self.lower.get(word)
        if known is None:
            if len(self.lower) > 200_000:
                self.lower = {}
            known = self.lower[word] = word in COMMON or word in BEFORE_NAME or (self.case is not None and self.case[word_bucket(word)] >= ORDINARY)
        return known

    def code(self, *what) -> int:
        """The hashed number of a feature; remembered up to a bound."""
        known = self.codes.get(what)
        if known is None:
            if len(self.codes) > 400_000:
                self.codes = {}
            known = self.codes[what] = what[0] * DIMENSIONS + (zlib.crc32("|".join(map(str, what)).encode("utf-8", "surrogatepass")) & (DIMENSIONS - 1))
        return known

    # ---- one labeler list a kind; every vote is one character

    def _email(self, t: str, a: int, b: int, spelled: bool) -> str:
        s = t[a:b]
        local = re.split(r"@|\s*[\[({<]\s*at\s*[\])}>]\s*|\s+at\s+", s, maxsplit=1, flags=re.I)[0]
        top = re.search(r"([A-Za-z]+)\W*$", s)
        before = t[max(0, a - 24) : a].lower()
        return (
            ("0" if spelled else "+")
            + ("+" if spelled and re.search(r"[\[({<]", s) else "0")
            + ("+" if re.search(r"[A-Za-z]", local) else "-")
            + ("+" if top and len(top[1]) >= 2 else "-")
            + ("+" if re.search(r"(?:mail|cc|to|;|<|\(|\|)\W*$", before) else "0")
            + ("-" if spelled and not re.search(r"[\[({<]|\bdot\b", s, re.I) else "0")
        )

    def _phone(self, t: str, a: int, b: int) -> str:
        s = EXTENSION.sub("", t[a:b])
        before, after = t[max(0, a - 24) : a], t[b : b + 24]
        digits = sum(map(str.isdigit, s))
        return (
            ("+" if NANP.fullmatch(s) else "0")
            + ("+" if OTHER_PHONE.fullmatch(s) else "0")
            + ("+" if PHONE_BEFORE.search(before) else "0")
            + ("-" if PART_BEFORE.search(before) and not PHONE_BEFORE.search(before) else "0")
            + ("-" if PART_AFTER.match(after) else "0")
            + ("-" if SSN.fullmatch(s) or ID_BEFORE.search(before) else "0")
            + ("-" if not 9 <= digits <= 13 else "0")
            + ("-" if re.fullmatch(r"\d{1,5}[.\s-]\d{2,8}(?:[.\s-]\d{1,8})?", s) and not NANP.fullmatch(s) and not OTHER_PHONE.fullmatch(s) else "0")
        )

    def _id(self, t: str, a: int, b: int) -> str:
        s = t[a:b]
        before, after = t[max(0, a - 32) : a], t[b : b + 24]
        return (
            ("+" if ID_BEFORE.search(before) else "0")
            + ("+" if re.fullmatch(r"[A-Z]\d{3}-\d{4}-\d{4}", s) else "0")
            + ("+" if re.fullmatch(r"\d{2}\.\d{3}\.\d{3}-[A-Z]", s) else "0")
            + ("-" if PART_BEFORE.search(before) and not ID_BEFORE.search(before) else "0")
            + ("-" if PART_AFTER.match(after) else "0")
            + ("-" if not ID_BEFORE.search(before) and re.fullmatch(r"[A-Z]{1,2}\d{7}|\d{8}-?[A-Z]|\d{2}-\d{7}", s) else "0")
        )

    def _address(self, t: str, a: int, b: int, pattern: str) -> str:
        s = t[a:b]
        before, after = t[max(0, a - 24) : a], t[b : b + 40]
        words = [w for w in re.findall(r"[^\W\d_]+", s.lower())]
        number = re.match(r"\d+", s)
        return (
            ("+" if pattern == "en" else "0")
            + ("+" if pattern in ("de", "fr", "es") else "0")
            + ("+" if ADDRESS_BEFORE.search(before) else "0")
            + ("+" if ADDRESS_AFTER.match(after) else "0")
            + ("-" if any(" ".join(words[i:]) in self.full_makers for i in range(len(words))) else "0")
            + ("-" if NO_ADDRESS_BEFORE.search(before) else "0")
            + ("-" if number and len(number[0]) > 5 else "0")
        )

    def _name(self, t: str, a: int, b: int, words: list[str], titled: bool, inverted: bool, line: tuple[int, int], continued: bool, near_contact: bool, in_address: bool) -> str:
        before, after = t[max(line[0], a - 40) : a], t[b : min(line[1], b + 32)]
        low = [w.lower() for w in words]
        given, family = (low[-1], low[0]) if inverted else (low[0], low[-1])
        alone = re.fullmatch(r"[\s>*•#/–—-]*(?:thanks|thank you|regards|best|yours|signed|cheers)?[,:\s/-]*", before, re.I) and re.fullmatch(r"[\s.,]*", after)
        return (
            ("+" if given in self.given else "0")
            + ("+" if family in self.family else "0")
            + ("+" if titled else "0")
            + ("+" if NAME_BEFORE.search(before) else "0")
            + ("+" if NAME_AFTER.match(after) else "0")
            + ("+" if alone and not titled else "0")
            + ("+" if near_contact else "0")
            + ("-" if any(w in TITLES or self.ordinary(w) for w in low) else "0")
            + ("-" if any(w in self.makers for w in low) else "0")
            + ("-" if THING_AFTER.match(after) and not titled else "0")
            + ("-" if THING_BEFORE.search(before) and not titled and not NAME_BEFORE.search(before) else "0")
            + ("-" if self.things is not None and any(self.things[word_bucket(w)] >= ORDINARY for w in low if len(w) > 2) else "0")
            + ("-" if in_address else "0")
            + ("-" if continued else "0")
            + ("-" if t[a:b].isupper() and _shouting(t[line[0] : line[1]]) and given not in self.given and family not in self.family else "0")
            + ("-" if family in self.given or (given in self.family and not titled) else "0")
        )

    # ---- features of the span classifier

    def _features(self, kind: int, t: str, a: int, b: int, votes: str, words: list[str], line: tuple[int, int]) -> list[int]:
        """What the span classifier sees: votes, the words around the span singly, in pairs and in threes, its shape, and
        for names the words themselves with their ends."""
        before = _AROUND.findall(t[max(line[0], a - 48) : a].lower())[-3:]
        after = _AROUND.findall(t[b : min(line[1], b + 48)].lower())[:3]
        while len(before) < 3:
            before.insert(0, "^")
        while len(after) < 3:
            after.append("$")
        code = self.code
        out = {code(kind, "v", i, v) for i, v in enumerate(votes) if v != "0"}
        out |= {
            code(kind, "p", before[2]), code(kind, "n", after[0]), code(kind, "pp", before[1], before[2]), code(kind, "nn", after[0], after[1]),
            code(kind, "ppp", *before), code(kind, "nnn", *after), code(kind, "pn", before[2], after[0]), code(kind, "k", len(words)), code(kind, "bias"),
        }
        if kind == 4:
            for i, w in enumerate(words):
                low = w.lower()
                place = "f" if i == 0 else "l" if i == len(words) - 1 else "m"
                out |= {code(kind, "w", place, low), code(kind, "x", place, low[-3:]), code(kind, "W", low), code(kind, "c", place, self.case[word_bucket(low)] // 32 if self.case is not None else -1)}
        else:
            out.add(code(kind, "s", _shape(t[a:b])))
        return sorted(out)

    # ---- all candidates of a text

    def candidates(self, t: str) -> list[Candidate]:
        """Candidates of a whole text, in order of kind and place."""
        found: list[Candidate] = []

        def line_of(a: int) -> tuple[int, int]:
            start = max(t.rfind("\n", 0, a), t.rfind("\r", 0, a)) + 1
            ends = [e for e in (t.find("\n", a), t.find("\r", a)) if e >= 0]
            return start, min(ends) if ends else len(t)

        def add(kind: int, a: int, b: int, votes: str, words: list[str], line: tuple[int, int]) -> None:
            found.append(Candidate(kind, a, b, votes, self._features(kind, t, a, b, votes, words, line)))

        contacts: list[tuple[int, int]] = []
        if "@" in t:
            for m in EMAIL.finditer(t):
                contacts.append(m.span())
                add(0, *m.span(), self._email(t, *m.span(), False), [], line_of(m.start()))
        low = t.lower()
        if "at" in low and _SPELLED_HINT.search(low):
            for m in EMAIL_SPELLED.finditer(t):
                contacts.append(m.span())
                add(0, *m.span(), self._email(t, *m.span(), True), [], line_of(m.start()))
        for m in PHONE.finditer(t):
            if 7 <= sum(map(str.isdigit, m[0])) <= 15:
                votes = self._phone(t, *m.span())
                if "+" in votes[:3]:
                    contacts.append(m.span())
                add(1, *m.span(), votes, [], line_of(m.start()))
        for m in ID_NUMBER.finditer(t):
            add(2, *m.span(), self._id(t, *m.span()), [], line_of(m.start()))
        streets: list[tuple[int, int]] = []
        for name, pattern, hints in _ADDRESSES:
            if hints and not any(h in low for h in hints):
                continue
            for m in pattern.finditer(t):
                streets.append(m.span())
                add(3, *m.span(), self._address(t, *m.span(), name), [], line_of(m.start()))
        self._names(t, found, contacts, streets, line_of, add)
        return found

    def _names(self, t, found, contacts, streets, line_of, add) -> None:
        runs: list[list[re.Match]] = []
        for m in _PIECE.finditer(t):
            if runs and _GAP.fullmatch(t, runs[-1][-1].end(), m.start()):
                runs[-1].append(m)
            else:
                runs.append([m])
        for k, run in enumerate(runs):
            at = run[0].start()
            follows_title = False
            if at > 1 and t[at - 1] in " \u00a0":
                last = t[max(0, at - 12) : at].split()[-1:]
                follows_title = bool(last) and last[0].strip("().,;:/\"'•*>-–—").lower() in TITLES
            followed = k + 1 < len(runs) and t[run[-1].end() : runs[k + 1][0].start()] in (", ", ",\u00a0")
            if len(run) == 1 and not follows_title and not followed:
                continue
            spans: list[tuple[list[re.Match], bool]] = []
            for i in range(len(run)):
                titled = run[i - 1][0].lower().rstrip(".") in TITLES and (i == 1 or len(run[i - 1][0]) > 2) if i else follows_title  # "Jo M. Lee" has an initial
                for n in (1, 2, 3):
                    piece = run[i : i + n]
                    if len(piece) < n or piece[-1][0].endswith(".") or (n == 1 and not titled):
                        continue
                    if n == 3 and not piece[1][0].endswith(".") and not titled:
                        continue
                    if any(m[0].lower() in NEVER for m in piece):
                        continue
                    if i == 0 and run[0][0].lower().rstrip(".") in TITLES and len(run) > 1:
                        continue
                    spans.append((piece, titled))
            for piece, titled in spans:
                i = run.index(piece[0])
                left = run[i - 1][0].lower() if i else ""
                continued = bool(left) and not self.ordinary(left) and left.rstrip(".") not in TITLES and left not in self.makers
                self._add_name(t, piece, titled, False, continued, contacts, streets, line_of, add)
            if followed:
                both = [run[-1], runs[k + 1][0]]
                second = both[1][0].lower()
                a, b = both[0].start(), both[1].end()
                likely = not any(w in self.makers or self.ordinary(w) for w in (both[0][0].lower(), second))
                if likely or second in self.given or both[0][0].lower() in self.family or second.endswith("."):
                    self._add_name(t, both, False, True, len(run) > 1 and not self.ordinary(run[-2][0].lower()), contacts, streets, line_of, add)

    def _add_name(self, t, piece, titled, inverted, continued, contacts, streets, line_of, add) -> None:
        a, b = piece[0].start(), piece[-1].end()
        line = line_of(a)
        near = any(0 <= c - b <= 4 and "." not in t[b:c] or 0 <= a - d <= 2 and not set(t[d:a]) & set(".\n\r") and t[d:a].strip() for c, d in contacts)
        inside = any(c <= a < d for c, d in streets)
        words = [m[0] for m in piece]
        add(4, a, b, self._name(t, a, b, words, titled, inverted, line, continued, near, inside), words, line)
