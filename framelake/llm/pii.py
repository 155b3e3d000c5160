"""Personal data: base patterns plus a semi-Markov conditional random field.

The base patterns (email, ip, card, phone) are matched exactly, in time linear in the text. The field then scores
candidate segments around triggers (digits, @, key words): features look at whole spans (digit count, shape,
checksum, grouping, the words before), and a dynamic programme over segments of bounded length chooses boundaries
and types jointly. Base spans are fixed segments; the field adds spans between them, of the same kinds and of the
kind "secret" (passwords, tokens, access keys).

The weights are trained here, by maximum likelihood with forward-backward over segments, on sentences made by a
seeded generator; nothing is learnt from the corpus.

The field sees AHEAD characters before a trigger and BEHIND after it, and the whole run of letters and digits that
this cuts; an entity has at most SEGMENT atoms and LONGEST characters, or is one long token: what follows = or : without a
space, or a signed token of three parts. Such a token is an atom of any length, whatever marks are inside.

Edge cases: null and empty texts have no spans; repeated rows and null ids are handled row by row; texts may be of
any length, with or without spaces: work is linear in the text, as a segment's length is bounded.
"""

from __future__ import annotations

import hashlib
import heapq
import random
import re
from collections import deque
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import slices

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
#: Most atoms and characters in one entity that the field finds, long tokens apart.
SEGMENT, LONGEST = 24, 80
#: Characters that the field sees before and after a trigger.
AHEAD, BEHIND = 48, 64
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

EMAIL_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP_RUN = re.compile(r"[0-9][0-9.]*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+@-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str):
    """A match lies within one run of its characters; within a run, each @ takes all that precedes it."""
    at = text.find("@")
    while at >= 0:
        left = at
        while left > 0 and text[left - 1] in LOCAL:
            left -= 1
        right = EMAIL_RUN.match(text, at).end()
        start = left
        while 0 <= at < right:
            domain = DOMAIN.match(text, at + 1, right) if at > start else None
            if domain:
                yield start, domain.end()
            start = domain.end() if domain else at + 1
            at = text.find("@", start, right)
        at = text.find("@", right)


def _ips(text: str):
    """Four adjoining groups of digits, leftmost first; a group is a whole run of digits."""
    for run in IP_RUN.finditer(text):
        if run.group().count(".") < 3:
            continue
        groups, start = [], run.start()
        for part in run.group().split("."):
            groups.append((start, part))
            start += len(part) + 1
        i = 0
        while i + 4 <= len(groups):
            four = groups[i : i + 4]
            if all(p for _, p in four):
                if all(len(v) <= 3 and int(v or 0) <= 255 for v in (p.lstrip("0") for _, p in four)):
                    yield four[0][0], four[3][0] + len(four[3][1])
                i += 4
            else:
                i += 1


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then by kind as listed."""
    if not text:
        return []
    out = [(s, e, "email") for s, e in _emails(text)]
    out += [(s, e, "ip") for s, e in _ips(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return ordered(out)


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


# ---------------------------------------------------------------- the field

ATOM = re.compile(r"[A-Za-z0-9]{10,}|[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]|\s+")
#: Words that announce personal data, by kind.
CUES = {
    "email": ("email", "mail", "contact", "mailto"),
    "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "mastercard", "amex", "credit"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell"),
    "secret": ("password", "passwd", "pwd", "token", "secret", "apikey", "key"),
}
CUE_OF = {word: kind for kind, words in CUES.items() for word in words}
#: The field looks around these.
NUMBER_OR_AT = re.compile(r"[0-9]{3,}|@")
SPELLED_AT = re.compile(r"[(\[]at[)\]]", re.IGNORECASE)
SECRET_WORDS = ("password", "passwd", "pwd", "token", "secret", "apikey")
SECRET = re.compile(r"\b(?:password|passwd|pwd|token|secret|apikey)\b\s*[=:]", re.IGNORECASE)
DOTTED = re.compile(r"(?:[0-9]{1,3} ?\. ?){3}[0-9]{1,3}")
NO_DIGIT = re.compile(r"[^0-9]+")
MAIL_LIKE = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+")
KEY_LIKE = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}")
CODE = re.compile(r"[A-Za-z0-9_+/=-]{10,}")
#: Tokens of more than LONGEST characters after an assignment; three parts that begin as an encoded JSON object does.
ASSIGNED_LONG = re.compile(r"[=:][ \t]*[\"']?(?P<token>[A-Za-z0-9][A-Za-z0-9_+/=.~-]{80,})")
SIGNED = re.compile(r"(?<![A-Za-z0-9_.-])(?P<token>eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)")
CODE_ONLY = re.compile(r"[^A-Za-z0-9]+")
GROUPED_PHONE = re.compile(r"(?:\+?[0-9]{1,3}[ .-])?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}")
GROUPED_CARD = re.compile(r"[0-9]{4}([ ./-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}")


@lru_cache(maxsize=20_000)
def span_features(span: str) -> tuple[str, ...]:
    """Features of a whole candidate span; none looks at single atoms."""
    digits = NO_DIGIT.sub("", span)
    letters = sum(map(str.isalpha, span))
    spaces = sum(map(str.isspace, span))
    marks = len(span) - len(digits) - letters - spaces
    n = len(digits)
    out = [f"digits={n if n < 4 else '4-8' if n < 9 else '9-11' if n < 12 else '12-15' if n < 16 else '16-19' if n < 20 else '20+'}"]
    out.append("letters=" + ("0" if not letters else "1-3" if letters < 4 else "4+"))
    out.append("spaces=" + ("0" if not spaces else "1-3" if spaces < 4 else "4+"))
    out.append("marks=" + ("0" if not marks else "1-3" if marks < 4 else "4+"))
    if marks and letters and MAIL_LIKE.fullmatch(span):
        out.append("mail-like")
    if not letters:
        if "." in span and DOTTED.fullmatch(span) and all(int(p) <= 255 for p in re.findall("[0-9]+", span)):
            out.append("quad")
        if n > 6 and GROUPED_PHONE.fullmatch(span):
            out.append("phone-groups")
        if n > 12 and GROUPED_CARD.fullmatch(span):
            out.append("card-groups")
        if 12 <= n <= 19 and luhn(digits):
            out.append("checksum")
    if KEY_LIKE.fullmatch(span):
        out.append("access-key")
    if CODE.fullmatch(span):
        out.append("code" + ("+digits" if n else "") + ("+letters" if letters else "") + ("+long" if len(span) >= 16 else ""))
    if "\n" in span:
        out.append("line-break")
    if span[0] == "+":
        out.append("plus")
    if not (span[-1].isalnum() and (span[0].isalnum() or span[0] in "+(")):
        out.append("ragged")
    return tuple(out)


LETTERS = re.compile(r"[A-Za-z]+")
ASSIGNED = re.compile(r"[=:]\s*[\"']?$")


def before_features(text: str, start: int) -> tuple[str, ...]:
    """What stands before a span: key words, an assignment, a character that the span cuts off."""
    before = text[max(0, start - 40) : start]
    out = [f"cue={CUE_OF[w.lower()]}" for w in LETTERS.findall(before)[-3:] if w.lower() in CUE_OF]
    if ("=" in before or ":" in before) and ASSIGNED.search(before):
        out.append("assigned")
    if start and (text[start - 1].isalnum() or text[start - 1] in "+@_%" or text[start - 1] in ".-" and text[max(0, start - 2) : start - 1].isalnum()):
        out.append("cut-left")
    return tuple(out)


def after_features(text: str, end: int) -> tuple[str, ...]:
    if end < len(text) and (text[end].isalnum() or text[end] in "@_%" or text[end] in ".-" and text[end + 1 : end + 2].isalnum()):
        return ("cut-right",)
    return ()


class Region:
    """A stretch of text with its candidate segments: pairs of atom numbers."""

    def __init__(self, text: str, atoms: list[tuple[int, int]], walls: frozenset = frozenset(), long: frozenset = frozenset()):
        self.text, self.atoms, self.walls, self.long = text, atoms, walls, long  # long: starts of long tokens

    def candidates(self) -> Iterator[tuple[int, int]]:
        """Segments by start, then by end; only the flags of the next SEGMENT atoms are held."""
        text, atoms, walls, n = self.text, self.atoms, self.walls, len(self.atoms)
        flags: deque[tuple[bool, bool, bool, bool]] = deque()  # wall, shown, strong, may end a segment
        for i in range(n):
            while len(flags) < SEGMENT and i + len(flags) < n:
                s, e = atoms[i + len(flags)]
                head, wall = text[s], s in walls
                shown = not head.isspace() and not wall
                strong = not wall and (head.isdigit() or head == "@" or e - s >= 10 or text[s:e].lower() == "at")
                flags.append((wall, shown, strong, shown and (head.isalnum() or head in "=+/_")))
            if flags[0][1]:
                good, start = False, atoms[i][0]
                for j, (wall, _, strong, ends) in enumerate(flags, i):
                    length = atoms[j][1] - start
                    if wall or length > LONGEST and not (j == i and start in self.long):
                        break
                    good = good or strong
                    if good and length >= 7 and ends:
                        yield i, j + 1
            flags.popleft()

    @cached_property
    def segments(self) -> list[tuple[int, int]]:
        return list(self.candidates())

    def features(self, segment: tuple[int, int]) -> tuple[str, ...]:
        s, e = self.atoms[segment[0]][0], self.atoms[segment[1] - 1][1]
        return self.shape(*segment) + before_features(self.text, s) + after_features(self.text, e)


    def shape(self, i: int, j: int) -> tuple[str, ...]:
        """Features of a segment's span; a long token's are those of its first letters and digits."""
        s, e = self.atoms[i][0], self.atoms[j - 1][1]
        if s not in self.long or j != i + 1:
            return span_features(self.text[s:e])
        signed = ("access-key",) if SIGNED.fullmatch(self.text, s, e) else ()
        return span_features(CODE_ONLY.sub("", self.text[s : s + LONGEST])[:40]) + signed


class Field:
    """Weights by kind and feature. A region's other atoms are segments of one atom with score 0."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights  # feature -> score by kind
        self.zero = np.zeros(len(KINDS))
        self.sums: dict[tuple[str, ...], np.ndarray] = {}

    def total(self, features: tuple[str, ...]) -> np.ndarray:
        """Summed weights; the features of few thousand spans, starts and ends recur again and again."""
        found = self.sums.get(features)
        if found is None:
            if len(self.sums) > 20_000:
                self.sums.clear()
            found = self.sums[features] = sum((self.weights.get(f, self.zero) for f in features), self.zero)
        return found

    def scores(self, region: Region) -> Iterator[np.ndarray]:
        """By kind, for each candidate in order; what a start or an end adds is held while candidates share it."""
        text, atoms, total, bias = region.text, region.atoms, self.total, self.weights["bias"]
        at, before, after = -1, bias, {}
        for i, j in region.candidates():
            if i != at:
                for k in range(at + 1, i + 1):
                    after.pop(k, None)
                at, before = i, bias + total(before_features(text, atoms[i][0]))
            if j not in after:
                after[j] = total(after_features(text, atoms[j - 1][1]))
            yield total(region.shape(i, j)) + before + after[j]

    def best(self, region: Region) -> list[tuple[int, int, str]]:
        """Viterbi over segments: the spans of the best segmentation. Only segments with a positive score are held."""
        ending: dict[int, list] = {}
        for (i, j), score in zip(region.candidates(), self.scores(region)):
            k = score.argmax()
            if score[k] > 0:
                ending.setdefault(j, []).append((i, float(score[k]), int(k)))
        best, back = [0.0], [None]
        for j in range(1, len(region.atoms) + 1):
            top, how = best[j - 1], None
            for i, score, k in ending.get(j, ()):
                if best[i] + score > top:
                    top, how = best[i] + score, (i, k)
            best.append(top)
            back.append(how)
        out, j = [], len(region.atoms)
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((region.atoms[i][0], region.atoms[j - 1][1], KINDS[k]))
                j = i
        return out[::-1]


def triggers(text: str) -> Iterator[re.Match]:
    """What no entity of any kind can do without, in order; the rarer patterns run only where their words occur.

    Spaced addresses may have short numbers only, and access keys neither digits nor a word before them.
    """
    found = [NUMBER_OR_AT.finditer(text), DOTTED.finditer(text)]
    if "AKIA" in text or "ASIA" in text:
        found.append(KEY_LIKE.finditer(text))
    low = text.lower()
    if "at)" in low or "at]" in low:
        found.append(SPELLED_AT.finditer(text))
    if any(w in low for w in SECRET_WORDS):
        found.append(SECRET.finditer(text))
    return heapq.merge(*found, key=lambda m: m.start())


RUN = re.compile(r"[A-Za-z0-9]*")


def long_tokens(text: str) -> list[tuple[int, int]]:
    """Disjoint, in order; marks that end a sentence or a line are no part of a token."""
    out: list[tuple[int, int]] = []
    for m in heapq.merge(ASSIGNED_LONG.finditer(text), SIGNED.finditer(text) if "eyJ" in text else (), key=lambda m: m.start("token")):
        s = m.start("token")
        e = s + len(m["token"].rstrip(".~-"))
        if e - s > (0 if m.re is SIGNED else LONGEST) and (not out or s >= out[-1][1]):
            out.append((s, e))
    return out


def regions(text: str, base: list[tuple[int, int, str]]) -> Iterator[Region]:
    """One after the other: disjoint stretches around triggers that base spans leave over; base spans are walls no segment crosses."""
    inside, tokens = joined(base), long_tokens(text)
    stretches: list[list[int]] = []
    at = 0
    for start, end in heapq.merge(((m.start(), m.end()) for m in triggers(text)), tokens):
        while at < len(inside) and inside[at][1] <= start:
            at += 1
        if at < len(inside) and inside[at][0] <= start:
            continue
        s, e = max(0, start - AHEAD), min(len(text), end + BEHIND)
        if stretches and s <= stretches[-1][1]:
            stretches[-1][1] = max(stretches[-1][1], e)
        else:
            stretches.append([s, e])
    past, at, turn = 0, 0, 0
    for s, e in stretches:
        least = max(past, s - 200)
        while s > least and not text[s].isspace():
            s -= 1
        atoms, begin, long = [], s, set()
        while turn < len(tokens) and tokens[turn][0] < e:
            a, b = tokens[turn]
            turn += 1
            if a >= begin and b <= e:
                atoms += [(m.start(), m.end()) for m in ATOM.finditer(text, begin, a)] + [(a, b)]
                long.add(a)
                begin = b
        atoms += [(m.start(), m.end()) for m in ATOM.finditer(text, begin, e)]
        if atoms and e < len(text) and text[e - 1].isalnum():
            atoms[-1] = (atoms[-1][0], RUN.match(text, atoms[-1][1], atoms[-1][1] + 200).end())
        past = max(e, atoms[-1][1]) if atoms else e
        walls = set()
        while at < len(inside) and inside[at][1] <= s:
            at += 1
        near = at
        for a, b in atoms:
            while near < len(inside) and inside[near][1] <= a:
                near += 1
            if near < len(inside) and inside[near][0] < b:
                walls.add(a)
        yield Region(text, atoms, frozenset(walls), frozenset(long))


def joined(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The stretches that spans, in order of their starts, cover: disjoint, in order."""
    out: list[tuple[int, int]] = []
    for s, e, _ in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def find(field: Field, text: str | None) -> tuple[list, list]:
    """Base spans, and all spans."""
    base = base_spans(text)
    if not text:
        return base, base
    added, inside, at = [], joined(base), 0
    for region in regions(text, base):
        for s, e, kind in field.best(region):
            while at < len(inside) and inside[at][1] <= s:
                at += 1
            if at == len(inside) or inside[at][0] >= e:
                added.append((s, e, kind))
    return base, ordered(sorted(set(base + added)))


# ---------------------------------------------------------------- training


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(("an", "er", "ti", "lo", "sch", "que", "ar", "re", "en", "os", "ne")) for _ in range(rng.randint(1, 4)))


def _entity(rng: random.Random) -> tuple[str, str, str]:
    """kind, words before, surface form."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kind = rng.choice(KINDS)
    cue = rng.choice(CUES[kind]) + rng.choice((": ", " ", " is ")) if rng.random() < 0.5 else ""
    if kind == "email":
        user, host = _word(rng) + rng.choice((".", "_", "")) + rng.choice((_word(rng), digits(2))), _word(rng) + digits(1)
        at, dot = rng.choice((("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", "."), ("(at)", ".")))
        return kind, cue, f"{user}{at}{host}{dot}{rng.choice(('com', 'org', 'net', 'de'))}"
    if kind == "ip":
        return kind, cue, rng.choice((".", " . ", ". ")).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        number = rng.choice("3456") + digits(14)
        number += next(d for d in "0123456789" if luhn(number + d))
        mark = rng.choice(("", " ", "-", ".", "/"))
        return kind, cue, mark.join(number[i : i + 4] for i in range(0, 16, 4))
    if kind == "phone":
        a, b, c = digits(3), digits(3), digits(4)
        return kind, cue, rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(1)} ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"{a} {b} {c}" if cue else f"({a}) {b} {c}"))
    if rng.random() < 0.4:
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        signs = letters + rng.choice(("", "234567"))  # a key may have no digit
        return kind, "", "AKIA" + "".join(rng.choice(signs) for _ in range(16))
    code = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((12, 18, 32, 40))))
    return kind, rng.choice(CUES["secret"][:6]) + rng.choice(("=", " = ", ": ", ' = "', '="')), code


def _unchecked(rng: random.Random) -> str:
    """A number of a card's length and grouping whose check digit is wrong."""
    number = "".join(rng.choice("0123456789") for _ in range(rng.choice((13, 14, 15, 16, 16, 16))))
    if luhn(number):
        number = number[:-1] + str((int(number[-1]) + rng.randint(1, 9)) % 10)
    mark = rng.choice(("", "", " ", "-"))
    return mark.join(number[i : i + 4] for i in range(0, len(number), 4))


def _plain(rng: random.Random) -> str:
    """Numbers, codes and names that are nobody's data."""
    n = rng.randint
    return rng.choice(
        (
            _unchecked(rng), _unchecked(rng),
            f"version {n(1, 9)}.{n(0, 9)}", f"{n(1900, 2030)}", f"{n(1, 999)}.{n(10, 99)}", f"{n(2000, 2030)}-{n(10, 12)}-{n(10, 28)}", f"{n(10, 23)}:{n(10, 59)}:{n(10, 59)}",
            f"{n(1, 9)},{n(100, 999)},{n(100, 999)}", f"{n(300, 999)}.{n(300, 999)}.{n(300, 999)}.{n(300, 999)}", f"{n(10**9, 10**10)}", f"{n(10**12, 10**13)}00", f"{n(1, 99)} of {n(100, 999)}",
            f"{n(1900, 1960)}-{n(1970, 2020)}", f"{n(1, 9)}.{n(1, 9)}.{n(100, 999)}", f"the key {_word(rng)}", f"token {_word(rng)} {_word(rng)}", f"{n(100, 999)}, {n(100, 999)}, {n(1000, 9999)}", f"@{_word(rng)}", f"{n(100, 999)}%", f"{n(10000, 99999)} {_word(rng)}",
            f"password {_word(rng)} {_word(rng)}", f"{_word(rng)}{_word(rng)}{_word(rng)}{_word(rng)}", f"{n(100, 999)} {n(100, 999)} {n(100, 999)}", f"{n(1, 12)}/{n(1, 28)}/{n(1990, 2030)}",
        )
    )


def sentences(n: int, seed: int) -> list[tuple[Region, dict[tuple[int, int], int]]]:
    """Regions with their true segments (pair of atom numbers -> number of the kind)."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(_word(rng) for _ in range(rng.randint(2, 4))) + rng.choice((" ", " ", ". ", ", "))
            if rng.random() < 0.55:
                kind, cue, form = _entity(rng)
                text += cue
                spans.append((len(text), len(text) + len(form), kind))
                text += form + ('"' if cue.endswith('"') else "") + rng.choice((" ", ". ", ", "))
            else:
                text += _plain(rng) + rng.choice((" ", ". ", ", "))
        text += _word(rng)
        atoms = [(m.start(), m.end()) for m in ATOM.finditer(text)]
        region = Region(text, atoms)
        starts, ends = {a: i for i, (a, _) in enumerate(atoms)}, {b: i + 1 for i, (_, b) in enumerate(atoms)}
        truth = {(starts.get(s), ends.get(e)): KINDS.index(k) for s, e, k in spans}
        if truth.keys() <= set(region.segments):
            out.append((region, truth))
    return out


def _sum(a: float, b: float) -> float:
    return max(a, b) + np.log1p(np.exp(-abs(a - b)))


@lru_cache(maxsize=2)
def train(n: int = 200, rounds: int = 10, seed: int = 5, rate: float = 0.35, decay: float = 2e-3) -> Field:
    """Stochastic gradient ascent (AdaGrad) on the log-likelihood of the true segmentations."""
    made = []
    for region, truth in sentences(n, seed):
        made.append((region, truth, [("bias", *dict.fromkeys(region.features(s))) for s in region.segments]))
    weights: dict[str, np.ndarray] = {f: np.zeros(len(KINDS)) for _, _, fs in made for x in fs for f in x}
    power = {f: np.full(len(KINDS), 1e-2) for f in weights}
    for _ in range(rounds):
        for region, truth, features in made:
            m = len(region.atoms)
            scores = np.array([sum(weights[f] for f in x) for x in features]) if features else np.zeros((0, len(KINDS)))
            total = scores.max(axis=1) + np.log(np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)) if len(scores) else np.zeros(0)
            by_end, by_start = [[] for _ in range(m + 1)], [[] for _ in range(m + 1)]
            for k, (i, j) in enumerate(region.segments):
                by_end[j].append((i, total[k]))
                by_start[i].append((j, total[k]))
            ahead, behind = np.zeros(m + 1), np.zeros(m + 1)
            for j in range(1, m + 1):
                ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[i] + t for i, t in by_end[j])])
            for i in range(m - 1, -1, -1):
                behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[j] + t for j, t in by_start[i])])
            gradient: dict[str, np.ndarray] = {}
            for k, (i, j) in enumerate(region.segments):
                off = ahead[i] + behind[j] - ahead[m]
                true = truth.get((i, j))
                if off + total[k] < -9 and true is None:
                    continue
                g = -np.exp(off + scores[k])
                if true is not None:
                    g[true] += 1
                for f in features[k]:
                    gradient[f] = gradient.get(f, 0) + g
            for f, g in gradient.items():
                g = g - decay * weights[f]
                power[f] += g * g
                weights[f] = weights[f] + rate * g / np.sqrt(power[f])
    return Field({f: np.clip(w, -20, 20) for f, w in weights.items()})


# ---------------------------------------------------------------- DataFrames


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per input row: counts and digest of the base spans, and all spans. No shuffle."""
    shared = spark.sparkContext.broadcast(train())  # a few hundred weights

    def run(batches):
        import pyarrow as pa

        field = shared.value
        types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in part.column("text").to_pylist():
                    base, every = find(field, text)
                    kinds = [k for _, _, k in base]
                    rows.append((*(kinds.count(k) for k in BASE_KINDS), hashlib.sha256(digest(base).encode()).hexdigest(), digest(every), len(every) - len(base)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def masked(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    if not spans:
        return text
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows with all their columns, spans masked in ``text`` and ``n_chars`` (where there is one) renewed."""
    shared = spark.sparkContext.broadcast(train())

    def run(batches):
        import pyarrow as pa

        field = shared.value
        for batch in batches:
            for part in slices(batch):
                found = [find(field, t)[1] for t in part.column("text").to_pylist()]
                if any(found):
                    texts = [masked(t, s) for t, s in zip(part.column("text").to_pylist(), found)]
                    at = part.schema.get_field_index("text")
                    part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                    if (n := part.schema.get_field_index("n_chars")) >= 0:
                        old = part.column(n).to_pylist()
                        part = part.set_column(n, part.schema.field(n), pa.array([len(t) if s else o for t, s, o in zip(texts, found, old)], part.schema.field(n).type))
                yield part

    return docs.mapInArrow(run, docs.schema)
