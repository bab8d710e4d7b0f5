"""Noisy-channel restoration of obfuscated words.

A word that holds digits or signs, or a letter twice running, and a run of words of one or
two characters become lattices: each character may stand for the letters it resembles, for a
repetition, or for nothing, and each gap of a run for a gap or for nothing. Viterbi search,
without pruning, finds the letters and gaps that the channel's costs and a character trigram
model together find likeliest. Numbers without any letter stay numbers, and words spelt in
pieces of three characters or more stay in pieces.
"""

from __future__ import annotations

import functools
import re

import numpy as np

#: Letters that a sign commonly stands for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Signs after a word that stand for no letter: a word of letters before them is read as it is without them.
STOPS = ".,;:?"
SEPARATORS = set(".-_*~'`,:;/\\ #^=\"&%")

LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
SIZE = 64
OTHER = SIZE - 1
CODE = {c: k + 1 for k, c in enumerate(LETTERS)}

#: Costs of the channel: a letter as itself, a sign for a letter, a letter repeated, a separator or other sign dropped, a sign at a word's edge dropped, a gap dropped.
SAME, AS_LETTER, REPEATED, DROPPED, NOISE, EDGE, JOINED = 0.05, 1.2, 0.4, 0.5, 5.0, 0.1, 1.0
CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
DOUBLE = re.compile(r"([^\W\d_])\1")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
#: Two or more words of one or two characters in a row; the last may have signs after it.
RUN = re.compile(r"(?<!\S)\S{1,2}(?=\s)(?:(?:\s++\S{1,2}(?!\S))++(?:\s++\S{1,2}[.,!?;:]++(?!\S))?|\s++\S{1,2}[.,!?;:]++(?!\S))")


def code_table() -> np.ndarray:
    """From a code point, or 0x17F for any beyond, to a letter's number; 0 for all that is no letter of the alphabet."""
    out = np.zeros(0x180, np.int32)
    for c, k in CODE.items():
        out[ord(c)] = k
        if len(c.upper()) == 1 and ord(c.upper()) < 0x180:
            out[ord(c.upper())] = k
    return out


_TABLE = code_table()


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of the letter trigrams of whole texts; a text's end is a gap."""
    points = np.frombuffer("  ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    k = _TABLE[np.minimum(points, 0x17F)]
    n = np.bincount((k[:-2] * SIZE + k[1:-1]) * SIZE + k[2:], minlength=SIZE**3)
    at = np.flatnonzero(n)
    return at, n[at]


def model(counts: np.ndarray) -> np.ndarray:
    """Costs, -ln p(c | a, b), at (a * SIZE + b) * SIZE + c, interpolated with bigrams and single letters."""
    tri = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 0.5) / (uni + 0.5).sum()
    p2 = (bi + 8 * p1[None]) / (bi.sum(1, keepdims=True) + 8)
    p3 = (tri + 8 * p2[None]) / (tri.sum(2, keepdims=True) + 8)
    p3[:, 0] = p2[0]  # a word's first letter doesn't hang on the word before
    return -np.log(p3).ravel().astype(np.float32)


def is_noisy(word: str) -> bool:
    """Whether a lower-case word is read through the lattice alone: most aren't, and cost a scan of their letters."""
    if word.isalpha():
        return TRIPLE.search(word) is not None
    m = CORE.search(word)
    if not m:
        return False
    core = m[0]
    if not any(c.isalpha() for c in core):
        return False
    edge = word[: m.start()] + word[m.end() :]
    return not core.isalpha() or any(c in LEET for c in edge) or TRIPLE.search(core) is not None


def plain(word: str) -> str:
    """A word without the signs around it."""
    m = CORE.search(word)
    return m[0] if m else ""


@functools.lru_cache(1 << 14)
def readings_of(o: str, again: bool, outside: bool) -> tuple[tuple[int, float, str], ...]:
    """What a character may stand for, by whether it is the one before again and whether it is outside the word's core."""
    if o == " ":
        return (0, SAME, " "), (-1, JOINED, "")
    some: list[tuple[int, float, str]] = []
    if o in CODE:
        some.append((CODE[o], SAME, o))
    elif o.isalpha():
        some.append((OTHER, SAME, o))
    some += [(CODE[x], AS_LETTER, x) for x in LEET.get(o, "")]
    if again and (o in CODE or o in LEET):
        some.append((-1, REPEATED, ""))
    if outside and not o.isalpha():
        some.append((-1, EDGE, ""))
    elif o in SEPARATORS:
        some.append((-1, DROPPED, ""))
    elif not o.isalpha():
        some.append((-1, NOISE, ""))
    return tuple(some)


def options(word: str) -> list[tuple[tuple[int, float, str], ...]]:
    """For each character of a lower-case word or run: what it may stand for, as (letter's number, cost, letter); number -1 for nothing, 0 for a gap."""
    m = CORE.search(word)
    first, end = m.span() if m else (0, len(word))
    return [readings_of(o, o == last, not first <= at < end) for at, (last, o) in enumerate(zip("\0" + word, word, strict=False))]


def decode(word: str, costs: list[float]) -> str:
    """The likeliest letters, and gaps, behind a lower-case word or run of words with single blanks."""
    return letters_alone(word, costs) if word.isalpha() else through_lattice(word, costs)


def letters_alone(word: str, costs: list[float]) -> str:
    """What the lattice says of a lower-case word of letters, without building it.

    Only a letter repeated leaves a choice: at most two states, the letter read more than once
    and read once, which the next other letter makes one again. Costs are summed as in the lattice.
    """
    out: list[str] = []
    last, two, total, copies = "", 0, 0.0, 0
    before, once = 0, None  # the state where the letter repeated is read once, if there is one
    for o in word:
        c = CODE.get(o, OTHER)
        if o != last or c == OTHER:
            kept = total + SAME + costs[two * SIZE + c]
            if once is not None:
                other = once + SAME + costs[before * SIZE + c]
                if other < kept:
                    kept, copies = other, 1
                once = None
            out.append(last * copies)
            last, two, total, copies = o, (two * SIZE + c) % (SIZE * SIZE), kept, 1
        elif once is None:
            once, before = total + REPEATED, two
            total, two, copies = total + SAME + costs[two * SIZE + c], c * SIZE + c, 2
        else:
            kept, left, other = total + SAME + costs[two * SIZE + c], total + REPEATED, once + SAME + costs[before * SIZE + c]
            total, copies = (left, copies) if left < kept else (kept, copies + 1)
            if other < total:
                total, copies = other, 2
            once += REPEATED
    if once is not None and once + costs[before * SIZE] < total + costs[two * SIZE]:
        copies = 1
    out.append(last * copies)
    return "".join(out)


def through_lattice(word: str, costs: list[float]) -> str:
    """The same for any word or run, by Viterbi search."""
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # by the last two letters
    for some in options(word):
        new: dict[int, tuple[float, tuple | None]] = {}
        for two, (cost, path) in states.items():
            for c, more, letter in some:
                if c < 0:
                    key, total, way = two, cost + more, path
                else:
                    key = (two * SIZE + c) % (SIZE * SIZE)
                    total, way = cost + more + costs[two * SIZE + c], (letter, path)
                if key not in new or total < new[key][0]:
                    new[key] = (total, way)
        states = new
    way = min((cost + costs[two * SIZE], k, path) for k, (two, (cost, path)) in enumerate(states.items()))[2]
    out = []
    while way:
        out.append(way[0])
        way = way[1]
    return "".join(reversed(out))


def readings(word: str, costs: list[float]) -> list[str]:
    """The words behind a lower-case word or run: what the lattice says; for words of letters with a double one also as they stand."""
    if " " in word:
        return decode(word, costs).split(" ")
    as_is = word.rstrip(STOPS)
    if not as_is.isalpha():
        if is_noisy(word):
            return [decode(word, costs)]
        as_is = plain(word)
        if not as_is.isalpha():
            return [as_is]
    if not DOUBLE.search(as_is):
        return [as_is]
    if TRIPLE.search(as_is):
        return [decode(word, costs)]
    return list(dict.fromkeys((as_is, decode(as_is, costs))))


def tokens(text: str) -> set[str]:
    """The different words of a text, lower-case, and its runs of short words."""
    low = text.lower()
    return {*low.split(), *(" ".join(run.split()) for run in RUN.findall(low))}
