"""Readings of dictionary outputs: tags, structure, base forms, and word analysis.

A dictionary's output is first cut into items: tags ``[Xy]``, marked stretches
``[Xp]...[X]``, and characters. Attributes, structure and base form are then read
off the items. An output with an unfinished tag gives no reading.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korpisto.session import ship
from korpisto.sources.vfst import Dictionary

# Attribute names, tag codes and their values.
ATTRIBUTES = (
    "BASEFORM", "CLASS", "COMPARISON", "FOCUS", "FSTOUTPUT", "KYSYMYSLIITE", "MALAGA_VAPAA_JALKIOSA", "MOOD", "NEGATIVE", "NUMBER", "PARTICIPLE",
    "PERSON", "POSSESSIVE", "POSSIBLE_GEOGRAPHICAL_NAME", "REQUIRE_FOLLOWING_VERB", "SIJAMUOTO", "STRUCTURE", "TENSE", "WEIGHT", "WORDBASES", "WORDIDS",
)
CLASS = {
    "n": "nimisana", "l": "laatusana", "nl": "nimisana_laatusana", "h": "huudahdussana", "ee": "etunimi", "es": "sukunimi", "ep": "paikannimi",
    "em": "nimi", "t": "teonsana", "a": "lyhenne", "s": "seikkasana", "u": "lukusana", "ur": "lukusana", "r": "asemosana", "c": "sidesana",
    "d": "suhdesana", "k": "kieltosana", "p": "etuliite",
}
CASE = {
    "n": "nimento", "g": "omanto", "p": "osanto", "es": "olento", "tr": "tulento", "ine": "sisaolento", "ela": "sisaeronto", "ill": "sisatulento",
    "ade": "ulkoolento", "abl": "ulkoeronto", "all": "ulkotulento", "ab": "vajanto", "ko": "seuranto", "in": "keinonto", "sti": "kerrontosti", "ak": "kohdanto",
}
COMPARISON = {"c": "comparative", "s": "superlative"}
MOOD = {
    "n1": "A-infinitive", "n2": "E-infinitive", "n3": "MA-infinitive", "n4": "MINEN-infinitive", "n5": "MAINEN-infinitive",
    "t": "indicative", "e": "conditional", "k": "imperative", "m": "potential",
}
NUMBER = {"y": "singular", "m": "plural"}
PERSON = {"1": "1", "2": "2", "3": "3", "4": "4"}
TENSE = {"p": "present_simple", "i": "past_imperfective"}
FOCUS = {"kin": "kin", "kaan": "kaan"}
POSSESSIVE = {"1y": "1s", "2y": "2s", "1m": "1p", "2m": "2p", "3": "3"}
NEGATIVE = {"t": "true", "f": "false", "b": "both"}
PARTICIPLE = {"v": "present_active", "a": "present_passive", "u": "past_active", "t": "past_passive", "m": "agent", "e": "negation"}
LONGEST_WORD, MOST_READINGS = 255, 100
# End of fixed values.

READING = "struct<" + ",".join(f"{a}:string" for a in ATTRIBUTES) + ">"
VOWELS = "aeiouyäö"
_ITEM = re.compile(r"\[X([a-z])\]([^\[]*)\[X\]|\[([^\[\]]+)\]|([^\[\]])", re.DOTALL)


@dataclass(frozen=True)
class Item:
    kind: str  # "tag", "mark" or "char"
    value: str  # a tag's code, a mark's letter, the character
    inner: str = ""  # a mark's content
    at: int = 0


def items(output: str) -> list[Item] | None:
    found, end = [], 0
    for m in _ITEM.finditer(output):
        if m.start() != end:
            return None
        end = m.end()
        if m[1]:
            found.append(Item("mark", m[1], m[2], m.start()))
        elif m[3]:
            found.append(Item("tag", m[3], at=m.start()))
        else:
            found.append(Item("char", m[4], at=m.start()))
    return found if end == len(output) else None


def simple_lower(text: str) -> str:
    return "".join(c.lower()[:1] for c in text)


def _tag(p: Item, start: str) -> bool:
    return p.kind == "tag" and p.value.startswith(start)


def _is(p: Item, char: str) -> bool:
    return p.kind == "char" and p.value == char


# --------------------------------------------------------------------- validity
@dataclass(frozen=True)
class Joint:
    """A letter behind a boundary [Bh], with what lies between it and the letters before."""

    before: str  # the two letters before, if any
    letter: str
    hyphen: bool
    eased: bool  # by [Icu] behind the joint before
    freed: bool  # by [Isf] behind the joint before


def _joints(parts: list[Item]) -> tuple[list[Joint], str]:
    """The joints of a compound, and the order of what requires hyphens: U [Icu], A [Ica], b a bare boundary, h a joint with a hyphen."""
    joints: list[Joint] = []
    order: list[str] = []
    letters, gap, since = "", "", ""  # gap: tags since the last letter, since: those since the last joint
    for k, p in enumerate(parts):
        hyphenated = k > 0 and _is(parts[k - 1], "-")
        if p.kind == "char" and p.value != "-":
            bare, joined, eased = (gap.rfind(x) for x in "bHU")
            if max(bare, joined) > eased:
                joints.append(Joint(letters[-2:], p.value, joined > bare, "U" in since, "S" in since))
                order += "h" * (joined > bare)
                since = ""
                if not joints[-1].hyphen or not _excused(joints):
                    letters = letters[:-1] + letters[-1:].lower()
            letters, gap = letters + p.value, ""
            continue
        mark = ""
        if p == Item("tag", "Bh", at=p.at):
            mark = "H" if hyphenated and k + 1 < len(parts) else "b"
        elif p.kind == "tag":
            mark = {"Icu": "U", "Ica": "A", "Isf": "S"}.get(p.value, "")
        gap, since = gap + mark, since + mark
        order += mark if mark in ("U", "A", "b") else ""
    return joints, "".join(order)


def _excused(joints: list[Joint]) -> bool:
    """Whether the last joint may have its hyphen anyway: at a word's start, behind "is", or by a tag; [Isf] holds for two joints."""
    here = joints[-1]
    return not here.before or here.before == "is" or here.eased or any(j.freed for j in joints[-2:])


def _sound(joints: list[Joint]) -> bool:
    """A hyphen stands just where two equal vowels meet or a digit ends a part."""
    here = joints[-1]
    last, first = here.before[-1:].lower(), here.letter.lower()[:1]
    needed = last.isascii() and last.isdigit() or (last == first and last != "" and last in VOWELS)
    return needed == here.hyphen or here.hyphen and _excused(joints)


#: A part that asks for a hyphen, then a boundary without one that no [Ica] makes good before the next.
_WITHOUT = re.compile("U[^h]*b[^Ab]*(?:b|$)")


def _name_before_noun(parts: list[Item]) -> bool:
    """Whether a name is joined without a hyphen to a common noun."""
    cut = max((k for k, p in enumerate(parts) if _is(p, "-")), default=-1) + 1
    tags = [p.value[:2] if p.value[:2] in ("Le", "Ln", "Dg") else p.value for p in parts[cut:] if p.kind == "tag"]

    def open_to(what: str, ends: tuple[str, ...]) -> bool:
        return what in tags and not set(ends) & set(tags[len(tags) - tags[::-1].index(what) :])

    return open_to("Le", ("Dg",)) and open_to("Ln", ("Le", "Ica"))


def valid(parts: list[Item]) -> bool:
    """Whether the hyphens of a compound are where they must be, and names are not joined to common nouns."""
    joints, order = _joints(parts)
    return not _WITHOUT.search(order) and not _name_before_noun(parts) and all(_sound(joints[: k + 1]) for k in range(len(joints)))


# -------------------------------------------------------------------- structure
@dataclass
class Stretch:
    """A run of items up to a joint of the word, which is the last item: a boundary, a bare hyphen, or a colon behind an abbreviation."""

    items: list[Item]
    joint: str  # "B", "-", ":", or "" at the word's end
    short: bool  # an abbreviation or a numeral in digits, at its end

    def body(self) -> list[Item]:
        return self.items[:-1] if self.joint else self.items


def _shape(n: int, name: bool, short: bool) -> str:
    """Case letters of ``n`` letters: i and p for a name's first and other letters, j and q in abbreviations."""
    first, other = ("j", "q") if short else ("i", "p")
    return (first + other * (n - 1) if name else other * n) if n > 0 else ""


def _is_short(tag: Item, parts: list[Item], total: int) -> bool:
    """Whether a class tag begins an abbreviation, or a numeral written in digits."""
    if _tag(tag, "La"):
        return True
    digits = tag.value == "Lu" and any(q.kind == "char" and q.at == tag.at + 4 and q.value in "0123456789" for q in parts)
    return (digits or tag.value == "Lur") and tag.at + 5 < total


def _stated(some: list[Item]) -> str:
    """The structure that the dictionary states in these items."""
    return "".join(p.inner for p in some if p.kind == "mark" and p.value == "r")


def _bare(some: list[Item]) -> int:
    """Letters of the items beyond those whose structure is stated; below 0 where more is stated than has come."""
    open_, taken = len(_stated(some).replace("=", "")), 0
    for k, p in enumerate(some):
        if p.kind == "char" and p.value not in "-:":
            taken += 1
        elif _is(p, "-") and p.at and taken < len(_stated(some[:k]).replace("=", "")):
            taken += 1  # a hyphen of the stated structure
    return taken - open_


def stretches(parts: list[Item], total: int) -> list[Stretch]:
    """The word cut at its joints."""
    out, first, short = [], 0, False
    for k, p in enumerate(parts):
        if _tag(p, "L"):
            short = _is_short(p, parts, total)
        joint = "B" if _tag(p, "B") and len(p.value) == 2 and p.value != "Bh" else p.value if p.kind == "char" and p.value in "-:" and _bare(parts[first:k]) > 0 else ""
        if joint == ":" and not short:
            joint = ""
        if joint:
            out.append(Stretch(parts[first : k + 1], joint, short))
            first, short = k + 1, short and joint != ":"
        elif _is(p, ":"):
            short = False
    return [*out, Stretch(parts[first:], "", short)]


def structure(parts: list[Item], size: int, total: int) -> str:
    """The expected case of each letter of a word of ``size`` letters, = at boundaries; ``total`` is the output's length."""
    out, name, hyphens = "=", False, 0  # hyphens: those of the word so far, whether the structure states them or not

    def room() -> int:
        return max(0, size - len(re.sub("[=-]", "", out)) - hyphens)

    for s in stretches(parts, total):
        for k, p in enumerate(s.body()):
            hyphens += _is(p, "-")
            if p.kind == "mark" and p.value == "r":
                name = False
                fits = next((n for n in range(len(p.inner) + 1) if len(re.sub("[=-]", "", p.inner[:n])) >= room()), len(p.inner))
                out += p.inner[:fits]
            elif _tag(p, "Le"):
                name = True
            elif _is(p, ":"):
                out += ":"
            elif _is(p, "-") and p.at and not _bare(s.items[:k]):
                out += "-"
            elif _is(p, "-") and out == "=":
                out = "-"
        joint = s.items[-1] if s.joint else None
        text = _shape(_bare(s.body()) if joint else room(), name, s.short)
        name &= not text
        if s.joint == "B":
            out += "=" * (joint.at == 1) + text
            out += "=" * (joint.at != 1 and joint.at + 5 < total and not out.endswith("="))
        else:
            out += text + s.joint
            hyphens += s.joint == "-"
    return out


def mend_structure(text: str, parts: list[Item]) -> str:
    """Lower case after derivations from names, a capital before a place name."""
    turn = None  # the hyphen behind a derivation that a place name follows, or that ends the word
    for k, p in enumerate(parts):
        if _is(p, "-") and turn is None:
            told = [q.value[:2] for q in parts[:k] if _tag(q, "De") or q == Item("tag", "Ln", at=q.at)]
            if told[-1:] == ["De"] and (k == len(parts) - 1 or any(q.kind == "tag" and q.value == "Lep" for q in parts[k:])):
                turn = k
    words = text.split("-")
    for k, p in enumerate(parts[:turn]):
        place = sum(_is(q, "-") for q in parts[:k])
        if _tag(p, "Dg") and place < len(words):
            words[place] = words[place].replace("i", "p")
    mended = "-".join(words)
    return mended if turn is None else re.sub("[ip]", "i", mended, count=1)


# ------------------------------------------------------------------- base forms
_NOUNS = ("Ln", "Ll", "Lnl")


def _numeral(parts: list[Item], head: str) -> str | None:
    """A numeral's base form: of each part the letters up to its marked base and that base, digits and hyphens as they are."""
    if any(p.kind == "tag" and p.value in _NOUNS for p in parts) or (parts and parts[-1] == Item("tag", "Bc", at=parts[-1].at)):
        return None
    lead = next((k for k, p in enumerate(parts) if p.kind != "char"), len(parts))
    if not (parts and parts[0].kind == "char" and parts[0].value in "-0123456789"):
        lead = 0
    out, done = head + "".join(p.value for p in parts[:lead]), lead > 0
    for p in parts[lead:]:
        if p.kind == "mark" and p.value in "pj":
            out, done = out + p.inner, True
        elif p.kind == "tag":
            done &= p.value != "Bc"
        elif p.kind == "char" and (not done or p.value == "-"):
            out += p.value
    return out


def _written(parts: list[Item], shape: str) -> dict[int, str]:
    """The characters by their item, with the structure's capitals."""
    cases = [c for c in shape if c != "="]
    chars = [k for k, p in enumerate(parts) if p.kind == "char"]
    return {k: parts[k].value.upper()[:1] if n < len(cases) and cases[n] in "ij" else parts[k].value for n, k in enumerate(chars)}


def base_form(parts: list[Item], shape: str) -> str | None:
    """The word with the last part's marked base and the structure's capitals."""
    chars = _written(parts, shape)
    classes = [k for k, p in enumerate(parts) if _tag(p, "L")]
    if classes and parts[classes[0]].value == "Lu":
        numeral = _numeral(parts[classes[0] + 1 :], _based(parts[: classes[0]], parts, chars, False))
        if numeral is not None:
            return numeral
    return _based(parts, parts, chars, True) or None


def _derives(parts: list[Item], k: int) -> bool:
    """Whether the word that ends before item ``k`` is derived: [De] behind its last hyphen and class, and that class takes it."""
    tags = [(i, p) for i, p in enumerate(parts[:k]) if p.kind == "tag" and (p.value == "De" or p.value.startswith("L"))]
    if not tags or tags[-1][1].value != "De" or any(_is(p, "-") for p in parts[tags[-1][0] : k]):
        return False
    last = next((p for _, p in reversed(tags) if p.value.startswith("L")), None)
    return last is None or last.value.startswith(("Ll", "Lnl"))


def _based(some: list[Item], parts: list[Item], chars: dict[int, str], whole: bool) -> str:
    """``some``, the first items of ``parts``, word by word between hyphens, each with the base that counts."""
    out, at, base, inside = "", 0, None, 0  # at: where the marked base begins, inside: hyphens of its own
    for k, p in enumerate(some):
        if p.kind == "mark" and p.value in "pj":
            at, base, inside = len(out), p.inner, p.inner.count("-")
        elif _is(p, "-") and inside:
            inside -= 1
            out += chars[k]
        elif _is(p, "-"):
            follows = any(q.kind == "tag" and q.value == "Lep" for q in parts[k + 1 :])
            if base is not None and follows and _derives(parts, k) and [q.value for q in parts[max(0, k - 2) : k]] != ["i", "s"]:
                plain = base.replace("=", "")
                out = out[:at] + plain[:1].upper()[:1] + plain[1:]
            out, base = out + chars[k], None
        elif p.kind == "char":
            out += chars[k]
    return out[:at] + base.replace("=", "") if whole and base is not None else out


_MARK = re.compile(r"\[X([a-z])\]([^\[]*)\[X\]")
_ENDS = re.compile(r"(-)(?=\[B)|\[L[^\[\]]*\]")


@dataclass(frozen=True)
class Word:
    """One part of a compound, or a suffix joined to it: what is written, the base and the identifier that the dictionary gives."""

    lead: str
    text: str
    base: str
    ident: str

    @staticmethod
    def of(piece: str, lead: str) -> Word:
        marks = _MARK.findall(piece)
        based = [("+" if m == "j" and inner else "") + inner for m, inner in marks if m in "pj"]
        text = re.sub(r"\[[^\[\]]*\]", "", _MARK.sub("", piece))
        return Word(lead if text else "", text, based[-1] if based else "", next((inner for m, inner in reversed(marks) if m == "s"), ""))

    def written(self, named: str) -> str:
        return self.lead + self.text + named

    def as_base(self) -> str:
        """The last word of a compound is written as its base."""
        lead = "" if self.base.startswith("+") else self.lead
        return lead + self.base.replace("=", "") if self.base else self.lead + self.text


def _words(output: str) -> list[Word]:
    """Parts end at class tags and at hyphens before a boundary; a suffix behind letters is a word joined without a sign."""
    out: list[Word] = []
    ends = [*((m.start(), m.end(), m[1]) for m in _ENDS.finditer(output)), (len(output), len(output), None)]
    first = 0
    for start, end, hyphen in ends:
        part, at = output[first:start], 0
        for m in _MARK.finditer(part):
            if m[1] == "j" and re.sub(r"\[[^\[\]]*\]", "", _MARK.sub("", part[: m.start()])):
                out.append(Word.of(part[at : m.start()], "+" if not at else ""))
                at = m.start()
        out.append(Word.of(part[at:], "+" if not at else ""))
        if hyphen:
            out.append(Word("+-", "", "", ""))
        first = end
    return out


def word_bases(parts: list[Item]) -> tuple[str, str | None]:
    """(WORDBASES, WORDIDS): parts joined by +, each with its base and its identifier in brackets."""
    output = "".join(f"[X{p.value}]{p.inner}[X]" if p.kind == "mark" else f"[{p.value}]" if p.kind == "tag" else p.value for p in parts)
    *others, last = _words(output)
    ident = lambda w: f"(w{w.ident})" * bool(w.ident)
    base = lambda w: f"({w.base})" * bool(w.base)
    bases = "".join(w.written(base(w)) for w in others) + last.as_base() + base(last)
    ids = "".join(w.written(ident(w)) for w in others) + last.as_base() + ident(last)
    return bases, ids if "[Xs]" in output else None


# ------------------------------------------------------------------- attributes
@dataclass(frozen=True)
class Seen:
    """A tag with what the tags behind it say."""

    letter: str
    code: str
    at: int
    cls: str | None  # the word's class, if it is told behind this tag
    mood: str | None
    joined: bool  # whether a compound's boundary lies behind


def _inflects(t: Seen, output: str) -> bool:
    return t.cls not in ("etuliite", "seikkasana")


def _classless(t: Seen, output: str) -> bool:
    return t.cls is None


def _participle(t: Seen, output: str) -> bool:
    return not t.joined and (t.cls in (None, "laatusana") or output.endswith("[Ln]"))


def _place(t: Seen, output: str) -> bool:
    return t.cls in (None, "nimisana") and not re.search(r"\[Bc\]|\[Ll\]", output[t.at :])


def _verb_follows(t: Seen, output: str) -> bool:
    return t.cls in (None, "teonsana") and t.mood not in ("E-infinitive", "MINEN-infinitive", "MA-infinitive")


#: Attribute, the letter of its tags, its values by code, and when a tag counts. Of the tags that count the last one wins, of _FIRST the first.
_ATTRIBUTES = (
    ("NUMBER", "N", NUMBER, _inflects), ("SIJAMUOTO", "S", CASE, _inflects), ("PERSON", "P", PERSON, None), ("MOOD", "T", MOOD, _classless), ("TENSE", "A", TENSE, None),
    ("KYSYMYSLIITE", "F", {"ko": "true"}, None), ("FOCUS", "F", FOCUS, None), ("POSSESSIVE", "O", POSSESSIVE, None), ("COMPARISON", "C", COMPARISON, _classless),
    ("NEGATIVE", "E", NEGATIVE, None), ("PARTICIPLE", "R", PARTICIPLE, _participle), ("MALAGA_VAPAA_JALKIOSA", "I", {"vj": "true"}, lambda t, output: not output.startswith("-")),
    ("POSSIBLE_GEOGRAPHICAL_NAME", "I", {"ca": "true"}, _place), ("REQUIRE_FOLLOWING_VERB", "I", {"ra": "A-infinitive", "rm": "MA-infinitive"}, _verb_follows),
)
_FIRST = ("REQUIRE_FOLLOWING_VERB",)


def _class_tag(tags: list[Item], output: str) -> int:
    """The tag that tells the word's class: the last class tag, or a boundary behind a hyphen, which makes a prefix; -1 if there is none."""
    prefix = lambda p: _tag(p, "Bc") and p.at >= 5 and output[: p.at].endswith(("-", "-[Bh]"))
    return max((k for k, p in enumerate(tags) if _tag(p, "L") or prefix(p)), default=-1)


def attributes(parts: list[Item], output: str) -> dict[str, str]:
    """Attributes from the tags; what a tag may say depends on those behind it."""
    tags = [p for p in parts if p.kind == "tag" and p.value]
    decides = _class_tag(tags, output)
    behind = {p.value for p in tags[decides + 1 :]}
    cls = None
    if decides >= 0:
        code = tags[decides].value[1:]
        cls = "etuliite" if _tag(tags[decides], "B") else CLASS.get(code)
        if code == "nl" and cls and ("Ssti" in [p.value for p in tags[decides + 1 :] if _tag(p, "S") and p.value[1:] in CASE][-1:] or behind & {f"C{c}" for c in COMPARISON} or output.startswith("[Lu]")):
            cls = "laatusana"
    joints = [k for k, p in enumerate(tags) if _tag(p, "Bc") and p.at >= 5]
    moods = [k for k, p in enumerate(tags) if _tag(p, "T") and p.value[1:] in MOOD and (k > decides or cls is None)]
    seen = [Seen(p.value[0], p.value[1:], p.at, cls if k < decides else None, MOOD[tags[moods[-1]].value[1:]] if moods and moods[-1] > k else None, bool(joints) and joints[-1] > k) for k, p in enumerate(tags)]
    out = {"CLASS": cls} if cls else {}
    for name, letter, values, counts in _ATTRIBUTES:
        found = [values[t.code] for t in seen if t.letter == letter and t.code in values and (counts is None or counts(t, output))]
        if found:
            out[name] = found[0 if name in _FIRST else -1]
    return out


def settle(reading: dict[str, str]) -> dict[str, str]:
    """Attributes that depend on each other."""
    out = dict(reading)
    if "NEGATIVE" in out and (out.get("CLASS") not in (None, "teonsana") or out.get("MOOD") in ("MINEN-infinitive", "E-infinitive", "MA-infinitive")):
        del out["NEGATIVE"]
    if out.get("PARTICIPLE") == "past_passive":
        out["CLASS"] = "laatusana"
    if out.get("SIJAMUOTO") == "kerrontosti":
        out.pop("NUMBER", None)
    if out.get("CLASS") in ("laatusana", "nimisana_laatusana"):
        out.setdefault("COMPARISON", "positive")
    elif out.get("CLASS") == "nimisana":
        out.pop("COMPARISON", None)
    return out


def organisation(reading: dict[str, str], parts: list[Item], output: str) -> dict[str, str] | None:
    """A second reading as an organisation's name, where the last part of a compound may be one."""
    if reading.get("CLASS") != "nimisana" or len(output) < 13 or output.startswith(("-", "[La]")):
        return None
    end = output.rfind("[Ion]", 8)
    last = output.rfind("[Bc]", 8, len(output) - 1)
    if end < 0 or last > end or output.find("[Bc]", 4, end) < 0:
        return None
    out = {**reading, "CLASS": "nimi"}
    out.pop("POSSIBLE_GEOGRAPHICAL_NAME", None)
    shape = reading.get("STRUCTURE", "")
    if len(shape) >= 2:
        out["STRUCTURE"] = shape[0] + "i" + shape[2:]
        base = base_form(parts, out["STRUCTURE"])
        if base:
            out["BASEFORM"] = base
    return out


def analyze(dictionary: Dictionary, word: str, full: bool = True) -> list[dict[str, str]]:
    """All readings of a word, in the dictionary's order."""
    if len(word) > LONGEST_WORD:
        return []
    out: list[dict[str, str]] = []
    for k, (text, _, _) in enumerate(dictionary.outputs(simple_lower(word))):
        if k >= MOST_READINGS:
            break
        parts = items(text)
        if parts is None or not valid(parts):
            continue
        reading = attributes(parts, text)
        reading["STRUCTURE"] = mend_structure(structure(parts, len(word), len(text)), parts)
        reading = settle(reading)
        second = organisation(reading, parts, text)
        if full:
            base = base_form(parts, reading["STRUCTURE"])
            bases, ids = word_bases(parts)
            reading |= {"FSTOUTPUT": text, "WORDBASES": bases} | ({"BASEFORM": base} if base else {}) | ({"WORDIDS": ids} if ids is not None else {})
        out.append(reading)
        if second:
            out.append(second)
    return out


# ------------------------------------------------------------------ data frames
_dictionaries: dict[str, Callable[[str], list[dict]]] = {}


def analyzer(data: bytes, remembered: int = 200_000):
    """A column function word -> array of readings; ``of_lists`` is the same for arrays of words.

    The dictionary travels once, as a broadcast of the size of its file. A worker
    remembers the readings of the words it saw last.
    """
    spark = SparkSession.getActiveSession()
    ship(spark)
    shared, mark = spark.sparkContext.broadcast(data), uuid.uuid4().hex
    reading = pa.struct([(a, pa.string()) for a in ATTRIBUTES])

    def known() -> Callable[[str], list[dict]]:
        if mark not in _dictionaries:
            d = Dictionary(shared.value)
            _dictionaries[mark] = lru_cache(remembered)(lambda w: [{a: r.get(a) for a in ATTRIBUTES} for r in analyze(d, w)] if w else [])
        return _dictionaries[mark]

    @F.arrow_udf(f"array<{READING}>")
    def readings(words: pa.Array) -> pa.Array:
        of = known()
        return pa.array([of(w) for w in words.to_pylist()], pa.list_(reading))

    @F.arrow_udf(f"array<array<{READING}>>")
    def of_lists(lists: pa.Array) -> pa.Array:
        of = known()
        return pa.array([None if ws is None else [of(w) for w in ws] for ws in lists.to_pylist()], pa.list_(pa.list_(reading)))

    readings.of_lists = of_lists
    return readings


def analyze_words(df: DataFrame, data: bytes, word: str = "word", name: str = "readings") -> DataFrame:
    """The input with each word's readings. Distinct words are analysed once and joined back."""
    known = df.select(word).distinct().withColumn(name, analyzer(data)(F.col(word)))
    return df.join(known, word, "left")


def is_valid_word(readings: Column) -> Column:
    return F.coalesce(F.size(readings) > 0, F.lit(False))


def first_base_form(readings: Column, word: Column) -> Column:
    """The first reading's base form, or the word."""
    return F.coalesce(F.get(readings, 0)["BASEFORM"], word)
