"""Personal data: fixed patterns, and a linear-chain CRF over word shapes that adds credentials, names and street addresses."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import blocks, mix64, text_buffers, word_bounds, word_hashes
from .workers import tidy

#: Kinds in the order in which spans of one start are listed; the last three are the CRF's.
KINDS = ("email", "ip", "card", "phone", "secret", "person", "address")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, failing ones dropped; each kind in time linear in the text.

    A local part starts at the earliest character of the run before its @, and a dotted
    chain of numbers splits into groups of four from its start, which is what leftmost
    matching gives.
    """
    out = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            a = m.start()
            while a > end and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                end = m.end()
                out.append(("email", a, end))
    if _DIGIT.search(text):
        if "." in text:
            for m in _DOTTED.finditer(text):
                groups = m.group().split(".")
                at = m.start()
                for k in range(0, len(groups) - 3, 4):
                    four = groups[k : k + 4]
                    size = sum(map(len, four)) + 3
                    if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in four):
                        out.append(("ip", at, at + size))
                    at += size + 1
        for m in _CARD.finditer(text):
            if m.end() - m.start() < 12:
                continue
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# The labelled table: one line of text a row, personal data between [[kind: and ]].  Slots stand for
# values that the seeded rule below makes, several for each row: {s} a credential, {w} a phrase of
# common words, {n} a person's name, {a} a street address, {h} a checksum or serial number, {p} words of random letters.
_LABELLED = """
password: [[secret:{s}]]
the password is [[secret:{s}]] for now
Password is "[[secret:{s}]]", do not share it
my password was [[secret:{s}]] until yesterday
pwd: [[secret:{s}]]
pwd=[[secret:{s}]]
user anna, pwd: [[secret:{s}]] and more
as agreed, password: [[secret:{s}]] for the server
log in there, pwd [[secret:{s}]] will do
passwd = '[[secret:{s}]]'
DB_PASSWORD=[[secret:{s}]]
SERVICE_SECRET_KEY=[[secret:{s}]]
export ACCESS_TOKEN=[[secret:{s}]]
api_key: [[secret:{s}]]
api_key = "[[secret:{s}]]"
"apiKey": "[[secret:{s}]]",
{{ "client_secret" : "[[secret:{s}]]" }}
secret = [[secret:{s}]] in the settings
the access key [[secret:{s}]] must be revoked
Authorization: Bearer [[secret:{s}]]
the bearer token [[secret:{s}]] was logged
auth token: [[secret:{s}]]
login with user admin and password [[secret:{s}]] here
credentials: admin / [[secret:{s}]]
token: '[[secret:{s}]]' expires soon
TOKEN: "[[secret:{s}]]"
key: "[[secret:{s}]]"
private key [[secret:{s}]] was leaked
'password': '[[secret:{w}]]'
the passphrase is "[[secret:{w}]]"
passphrase = "[[secret:{w}]]"
My name is [[person:{n}]] and I live here
name: [[person:{n}]]
Name: [[person:{n}]], born in May
Dear Mr. [[person:{n}]],
Mrs. [[person:{n}]] called again
Dr. [[person:{n}]] will see you now
please ask Ms. [[person:{n}]] about it
signed, [[person:{n}]]
Kind regards, [[person:{n}]]
contact: [[person:{n}]]
Herr [[person:{n}]] war nicht da
Frau [[person:{n}]] kommt morgen
je m'appelle [[person:{n}]] et vous
me llamo [[person:{n}]] y soy de aquí
He lives at [[address:{a}]] now
address: [[address:{a}]]
She moved to [[address:{a}]] in May
the shop in [[address:{a}]] opens today
my name is [[person:{n}]] by the way
Ship to [[address:{a}]] before Friday
our office at [[address:{a}]] is closed
Die Adresse ist [[address:{a}]] gleich hier
commit {h} fixed the build
sha256 {h} checked
revision {h} of the file
checksum: {h}
serial number {h} on the back
order {h} was shipped
The morning came over the harbour and the fishermen went out
Later that evening, Margaret opened the letters and Thomas read them
It was late. Nobody spoke. Outside, Winter had come early.
Paris and London are old cities. New York is younger.
The Great Gatsby and Other Stories of the Twenties
Elle regardait longtemps la mer. Personne ne répondait.
Les enfants étaient déjà là, près de la rivière où l'eau est claire
Manchmal regnet es im Sommer. Niemand wusste, warum die Straße leer war
Die Häuser in der Stadt waren größer als früher
Nadie respondía a la puerta. Entonces llegaron todos
El cielo de la ciudad estaba gris, y la gente no quería salir
the key to success is patience and the secret of it is time
the key point of this is a password: never share it
a token of love, a secret garden, the key to the city
your password must have eight letters and two digits
forgot your password? ask the help desk for a new token
access to the key room is for members only
the address of the house is not known, and the name is lost
the name of the rose is a book, and the street was empty
call +1 (017) 555-7713 before noon or +44 20 7946 0958
write to info@mail7.example.com or sales@shop.example.org
from 97.51.17.173 to 129.38.82.176 over night
He paid 4929348385146306 in two parts, see 9807915762804490 too
version 3.11.2 of 2024-05-17 at 12:30:45 costs 1,299.00
see https://www.example.com/en/853/?page=2&ref=x for this
see http://blog.example.net/de/612?utm_source=feed#top
Licensed under the Apache License, Version 2.0 (the "License");
Copyright 2019 The Authors. All rights reserved. MIT License
room 12b, floor 3rd, type A4, size 10x20, mp3 and h264 files
x = 5 and y = "seven" with z: 12
colour = "blue" and size = 10115
a="b" c='d' e=f g:h
e4 e5 Nf3 Nc6 Bb5 a6 B12 B2B C3PO R2D2
isbn 978-3-16-148410-0 page 77, issue 2024-000123-AB
Unfortunately nothing. Internationalization followed. Counterrevolutionaries
EVERYTHING WAS LOUD AND NOTHING WAS LEFT THERE
aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa bbbb
0000000000000000000000000000000000000000 1111
reallylongwordwithoutanymeaninginthemiddleofthesentence here
"quoted" words "and others" (in brackets) [or square]
one | two | three | four, | five. |
Rows. | Columns | values. | Totals 12 | 13.5 |
**bold** and ##heading## with %percent% and $price$ and more...
{p}
{p}
{p}
{p}
{p}
{p}
{p}
{p}
{p}
{p}
"""

#: Words whose identity is a feature besides their shape; of ``a_b`` the last part counts.
_CUES = (
    "password passwd pwd pass passphrase secret token key apikey access auth authorization bearer credentials private login user is was"
    " name mr mrs ms dr dear signed regards contact called my herr frau llamo appelle lives at address adresse ship to office"
    " street st road rd avenue ave lane drive square straße rue calle commit sha256 revision checksum serial number order = : \" ' , ("
).split()

_FIRST = "Anna John Maria Peter Lucía Jean Ingrid Omar Wei Sofia Karl Amélie".split()
_LAST = "Miller Schmidt García Dubois Novak Rossi Tanaka Olsen O'Neill Braun Lefèvre Romero".split()
_PLACE = "Oak Mill Station Church River Park Linden Garden Harbour King Forest Market".split()
_TOWN = "Berlin Lyon Madrid Leeds Boston Porto Graz Ghent".split()
_COMMON = "correct horse battery staple winter apple purple river seven lamps open window silent train green paper".split()
_HEX, _ALNUM = "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _made(slot: str, rng: np.random.Generator) -> str:
    """A value of a slot of the labelled table."""

    def of(letters: str, n: int) -> str:
        return "".join(letters[i] for i in rng.integers(0, len(letters), n))

    def one(words: list[str]) -> str:
        return words[rng.integers(0, len(words))]

    kind = rng.integers(0, 8)
    if slot == "s":
        if kind < 2:
            return of(_HEX if rng.random() < 0.6 else _HEX.upper(), int(rng.choice([16, 24, 32, 40, 48, 64])))
        if kind < 4:
            return of(_ALNUM + "+/", int(rng.integers(18, 45)))
        if kind == 4:
            return one(["sk", "pk", "ghp", "xoxb"]) + one(["_", "-"]) + of(_ALNUM, int(rng.integers(16, 36)))
        if kind == 5:
            return of(_ALNUM, 20) + "." + of(_ALNUM, 30) + "." + of(_ALNUM, 20)
        word = one(_COMMON)
        if rng.random() < 0.3:
            return f"{word}{of('0123456789', 1)}{one(['!', '?', '#', '-'])}{one(_COMMON)}{of('0123456789', 2)}"
        return (word if kind == 6 else word.capitalize()) + one(["", "!", "_", "#"]) + of("0123456789", int(rng.integers(1, 5))) + one(["", "", "x", "Zq"])
    if slot == "w":
        return " ".join(one(_COMMON) for _ in range(rng.integers(3, 6)))
    if slot == "n":
        return " ".join([one(_FIRST), one(_LAST)]) if kind < 7 else one(_LAST)
    if slot == "a":
        n, code = str(rng.integers(1, 400)), of("123456789", 5)
        return [
            f"{n} {one(_PLACE)} Street", f"{n} {one(_PLACE)} Road, {one(_TOWN)}", f"{n} {one(_PLACE)} {one(_PLACE)} Avenue", f"{one(_PLACE)} Straße {n}, {code} {one(_TOWN)}",
            f"{n} rue de {one(_TOWN)}, {code} {one(_TOWN)}", f"Calle {one(_PLACE)} {n}, {code} {one(_TOWN)}", f"{n} {one(_PLACE)} Lane", f"{n} {one(_PLACE)} Drive, {one(_TOWN)}",
        ][kind]
    if slot == "p":
        # Common short words and rarer long ones, some repeated, some capital, in sentences.
        known = ["is", "was", "to", "at", "my", "name", "key", *(of(_ALNUM[10:36], 1 + int(i**0.55)) for i in range(1, 60))]
        out: list[str] = []
        while len(out) < 40:
            word = known[min(65, int(rng.exponential(16)))]
            word = [word, word, word, word.capitalize(), word.capitalize(), word.upper(), word + ",", word + "."][rng.integers(0, 8)]
            out += [word] * (int(rng.integers(2, 15)) if rng.random() < 0.12 else 1)
        return " ".join(out)
    return of(_HEX, int(rng.choice([7, 12, 32, 40, 64])))


def labelled_lines(rows: str = _LABELLED, repeats: int = 5, seed: int = 11) -> list[str]:
    """The table with its slots filled, ``repeats`` times where a row has some."""
    rng = np.random.default_rng(seed)
    out = []
    for row in rows.strip("\n").split("\n"):
        slots = re.findall(r"\{([swnahp])\}", row)
        for _ in range(repeats if slots else 2):
            line = row
            for slot in slots:
                line = line.replace("{" + slot + "}", _made(slot, rng), 1)
            out.append(line.replace("{{", "{").replace("}}", "}"))
    return out


_KINDS = ("secret", "person", "address")
_LABELS = 1 + 2 * len(_KINDS)  # outside; the first and the following tokens of each kind
#: Tokens of a piece of a line; pieces are swept side by side and joined exactly.
_PIECE = 256
#: Bytes of text whose tokens are held at once, about a hundred bytes each.
_BLOCK = 1 << 18
_N = 1 << 12
_SLOTS = 3
_AROUND = (-3, -2, -1, 0, 1)

_SEPARATORS = b"=:\"'`,;()[]{}<>"
_SIGN = np.ones(256, dtype=np.int8)  # 0 space, 1 inside words, 2 a token of its own
_SIGN[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_SIGN[list(_SEPARATORS)] = 2
_CLASS = np.full(256, 4, dtype=np.int8)  # other
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_LENGTHS = np.array([2, 3, 5, 7, 10, 14, 19, 28, 44, 70])


def pii_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, ends, document numbers and cores: words, and each separator alone.

    A core is from a word's first to its last letter or digit; what has none, and is no
    separator, is no token.
    """
    n = len(data)
    if not n:
        return (np.zeros(0, dtype=np.int64),) * 5
    sign = _SIGN[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    inside = (sign[1:] == 1) & (sign[:-1] == 1) & ~first[1:n]
    start, end = sign > 0, sign > 0
    start[1:] &= ~inside
    end[:-1] &= ~inside
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    solid = np.flatnonzero(_CLASS[data] < 4)
    if len(solid):
        a = solid[np.minimum(np.searchsorted(solid, s), len(solid) - 1)]
        b = solid[np.maximum(np.searchsorted(solid, e) - 1, 0)] + 1
        plain = (a >= s) & (a < e)
        keep = plain | (sign[s] == 2)
        a, b = np.where(plain, a, s)[keep], np.where(plain, b, e)[keep]
        s, e = s[keep], e[keep]
    else:
        s, e = s[sign[s] == 2], e[sign[s] == 2]
        a, b = s, e
    return s, e, np.searchsorted(offsets, s, side="right") - 1, a, b


def token_features(data: np.ndarray, s: np.ndarray, e: np.ndarray, a: np.ndarray, b: np.ndarray, line: np.ndarray) -> np.ndarray:
    """(tokens, 3): the hashed shape of the core, its identity if it is a cue, and the signs around it with its case and whether it repeats a neighbour of its line."""
    kind = _CLASS[data]

    def count(flag: np.ndarray) -> np.ndarray:
        run = np.zeros(len(flag) + 1, dtype=np.int32)
        np.cumsum(flag, out=run[1:])
        return run[b] - run[a]

    digit, lower, upper = count(kind == 2), count(kind == 0), count(kind == 1)
    other, wide = count(kind == 4), count(kind == 3)
    change = np.zeros(len(data), dtype=bool)
    change[1:] = ((kind[1:] == 2) & (kind[:-1] != 2)) | ((kind[1:] != 2) & (kind[:-1] == 2))
    change[a] = False
    size = b - a
    length = np.searchsorted(_LENGTHS, size, side="right")
    capital = kind[a] == 1
    case = np.where(upper == 0, 0, np.where((upper == 1) & capital, 1, np.where(lower + wide == 0, 2, 3)))

    def hashed(*parts: np.ndarray) -> np.ndarray:
        h = np.full(len(s), 7, dtype=np.uint64)
        for part in parts:
            h = h * np.uint64(31) + part.astype(np.uint64)
        return (mix64(h) % np.uint64(_N - 256)).astype(np.int64)

    shape = hashed(digit > 0, lower + upper + wide > 0, np.minimum(count(change), 8), length, np.minimum(other, 2), digit == size)
    under = np.where(data == 95, np.arange(len(data)), -1)
    tail = np.maximum(a, np.maximum.accumulate(under)[b - 1] + 1)
    h = word_hashes(_LOW[data], np.where(tail < b, tail, a), b)
    same = np.zeros(len(s) + 1, dtype=bool)
    same[1:-1] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    edge = hashed(same[1:] | same[:-1], case, np.minimum(other, 2), digit > 0, size == 1, data[e - 1] * (b != e), data[a] * (digit + lower + upper + wide == 0))
    cues, order = _cue_hashes()
    at = np.minimum(np.searchsorted(cues, h), len(cues) - 1)
    known = np.where(cues[at] == h, 1 + order[at], 0)
    return np.stack([shape, _N - 256 + known, edge], axis=1)


@lru_cache(1)
def _cue_hashes() -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(" ".join(_CUES).encode(), dtype=np.uint8)
    s, e, _ = word_bounds(data, np.array([0, len(data)]))
    h = word_hashes(data, s, e)
    order = np.argsort(h)
    return h[order], order


def _step_mask() -> np.ndarray:
    """0 where a label may follow another; a following token only comes after its own kind."""
    mask = np.zeros((_LABELS, _LABELS))
    for k in range(2, _LABELS, 2):
        mask[:, k] = -1e9
        mask[[k - 1, k], k] = 0
    return mask


@dataclass(frozen=True)
class Crf:
    """Weights of the features of the tokens around (offset and slot, bucket, label), and of label pairs."""

    weights: np.ndarray
    step: np.ndarray

    def emissions(self, feats: np.ndarray, seq: np.ndarray) -> np.ndarray:
        out = np.zeros((len(feats), _LABELS), dtype=np.float32)
        for i, d in enumerate(_AROUND):
            here = slice(max(0, -d), len(feats) - max(0, d))
            there = slice(max(0, d), len(feats) - max(0, -d))
            if len(feats) <= abs(d):
                continue
            got = sum(self.weights[_SLOTS * i + k][feats[there, k]] for k in range(_SLOTS))
            out[here] += got if d == 0 else got * (seq[here] == seq[there])[:, None]
        return out


def _sweep(emit: np.ndarray, first: np.ndarray, size: np.ndarray, score: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last scores, back pointers) of pieces of tokens, from the scores of each piece's first token.

    ``score`` is (pieces, variants, labels) and changed in place.  The pieces are in order
    of size, largest first; one numpy step serves the t-th token of all of them.
    """
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # pieces longer than t
    back = np.zeros((len(emit), *score.shape[1:]), dtype=np.int8)
    for t in range(1, size[0]):
        k = live[t]
        way = score[:k, :, :, None] + step
        best = way.argmax(axis=2)
        back[first[:k] + t] = best
        score[:k] = np.take_along_axis(way, best[:, :, None, :], axis=2)[:, :, 0] + emit[first[:k] + t][:, None, :]
    return score, back


def _trace(back: np.ndarray, variant: np.ndarray, first: np.ndarray, size: np.ndarray, label: np.ndarray, out: np.ndarray) -> None:
    """Writes the labels of pieces (largest first) that end in ``label``, along the back pointers of their variants."""
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    label = label.copy()
    for t in range(size[0] - 1, -1, -1):
        k = live[t]
        at = first[:k] + t
        out[at] = label[:k]
        label[:k] = back[at, variant[:k], label[:k]]


def viterbi(emit: np.ndarray, seq: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best labels of many sequences at once, each decoded whole.

    A sequence is swept in pieces of ``_PIECE`` tokens side by side.  Its later pieces are
    swept once for each label that may stand before them; what is best there is known when
    the pieces before are joined on, a step a piece.
    """
    n = len(emit)
    out = np.zeros(n, dtype=np.int64)
    if not n:
        return out
    starts = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    first = np.flatnonzero(place % _PIECE == 0)
    size = np.diff(np.append(first, n))
    head = place[first] == 0
    found = []
    for heads in (True, False):
        own = np.flatnonzero(head == heads)
        own = own[np.argsort(-size[own], kind="stable")]
        # Tokens of these pieces alone, so that the wider pointers of later pieces stay small.
        width = size[own]
        to = np.cumsum(width) - width
        tokens = np.repeat(first[own] - to, width) + np.arange(width.sum())
        some = emit[tokens].astype(np.float64)
        if heads:
            score = some[to][:, None, :].copy()
            score[:, :, 2::2] = -np.inf  # nothing to follow
        else:
            score = some[to][:, None, :] + step if len(own) else np.zeros((0, _LABELS, _LABELS))
        last, back = _sweep(some, to, width, score, step) if len(own) else (score, np.zeros((0, _LABELS, _LABELS), dtype=np.int8))
        found.append((own, to, width, tokens, last, back))
    ends, variant = np.zeros(len(first), dtype=np.int64), np.zeros(len(first), dtype=np.int64)
    (own, *_, last, _), (later, *_, far, _) = found
    ends[own] = last[:, 0].argmax(axis=1)
    if len(later):
        row = np.zeros(len(first), dtype=np.int64)
        row[own], row[later] = np.arange(len(own)), np.arange(len(later))
        way = np.zeros((len(later), _LABELS), dtype=np.int64)
        for x in np.sort(later):  # in order of the text, so that the piece before is done
            before = last[row[x - 1], 0] if head[x - 1] else score
            total = before[:, None] + far[row[x]]
            way[row[x]], score = total.argmax(axis=0), total.max(axis=0)
            ends[x] = score.argmax()
        for x in np.sort(later)[::-1]:
            variant[x] = way[row[x], ends[x]]
            ends[x - 1] = variant[x]
    for pieces, to, width, tokens, _, back in found:
        if len(pieces):
            labels = np.zeros(len(tokens), dtype=np.int64)
            _trace(back, variant[pieces], to, width, ends[pieces], labels)
            out[tokens] = labels
    return out


def decode(emit: np.ndarray, seq: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The Viterbi labels; sequences that are surely outside throughout are not decoded.

    If at each token "outside" leads by more than two label pairs can make up for, no
    span of any length pays for itself.
    """
    lead = emit[:, 0] - emit[:, 1:].max(axis=1)
    open_ = np.unique(seq[lead <= 2 * max(0.0, step.max() - step[0, 0])])
    at = np.minimum(np.searchsorted(open_, seq), len(open_) - 1) if len(open_) else np.zeros(len(seq), dtype=np.int64)
    keep = np.flatnonzero(open_[at] == seq) if len(open_) else np.zeros(0, dtype=np.int64)
    out = np.zeros(len(emit), dtype=np.int64)
    out[keep] = viterbi(emit[keep], seq[keep], step)
    return out


def marked(line: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The text of a labelled line and its (kind, start, end)."""
    spans, at, text = [], 0, ""
    for m in re.finditer(r"\[\[(\w+):(.*?)\]\]", line):
        text += line[at : m.start()]
        spans.append((m[1], len(text), len(text) + len(m[2])))
        text += m[2]
        at = m.end()
    return text + line[at:], spans


def _training_rows(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and row numbers of all tokens of the table."""
    feats, labels, rows = [], [], []
    for i, line in enumerate(lines):
        text, spans = marked(line)
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        s, e, _, a, b = pii_tokens(data, np.array([0, len(data)]))
        y = np.zeros(len(s), dtype=np.int64)
        for kind, x, z in spans:
            x, z = len(text[:x].encode()), len(text[:z].encode())
            hit = np.flatnonzero((s < z) & (e > x))
            y[hit] = 2 + 2 * _KINDS.index(kind)
            y[hit[0]] -= 1
        feats.append(token_features(data, s, e, a, b, np.zeros(len(s))))
        labels.append(y)
        rows.append(np.full(len(s), i))
    return np.concatenate(feats), np.concatenate(labels), np.concatenate(rows)


def log_likelihood(emit: np.ndarray, step: np.ndarray, y: np.ndarray, rows: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The log-likelihood of all rows and its gradients by emission and label pair, by forward and backward sums of all rows at once."""
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    size = np.diff(np.concatenate([first, [len(rows)]]))
    m, t_max = len(first), int(size.max())
    at = first[:, None] + np.minimum(np.arange(t_max), size[:, None] - 1)
    live = np.arange(t_max) < size[:, None]
    e = emit[at]
    alpha, beta = np.zeros((t_max, m, _LABELS)), np.zeros((t_max, m, _LABELS))
    alpha[0] = e[:, 0]
    alpha[0][:, 2::2] = -1e9
    for t in range(1, t_max):
        new = np.logaddexp.reduce(alpha[t - 1][:, :, None] + step, axis=1) + e[:, t]
        alpha[t] = np.where(live[:, t, None], new, alpha[t - 1])
    for t in range(t_max - 2, -1, -1):
        new = np.logaddexp.reduce(step + (e[:, t + 1] + beta[t + 1])[:, None, :], axis=2)
        beta[t] = np.where(live[:, t + 1, None], new, beta[t + 1])
    z = np.logaddexp.reduce(alpha[-1], axis=1)
    by_emit = np.zeros_like(emit, dtype=np.float64)
    by_emit[at[live]] = -np.exp(alpha + beta - z[:, None]).transpose(1, 0, 2)[live]
    by_emit[np.arange(len(y)), y] += 1
    by_step = np.zeros((_LABELS, _LABELS))
    for t in range(1, t_max):
        on = live[:, t]
        pair = alpha[t - 1][on][:, :, None] + step + (e[on, t] + beta[t][on])[:, None, :] - z[on][:, None, None]
        by_step -= np.exp(pair).sum(axis=0)
    follows = rows[1:] == rows[:-1]
    np.add.at(by_step, (y[:-1][follows], y[1:][follows]), 1)
    total = emit[np.arange(len(y)), y].sum() + step[y[:-1], y[1:]][follows].sum() - z.sum()
    return float(total), by_emit, by_step


@lru_cache(1)
def train_crf(lines: tuple[str, ...] | None = None, rounds: int = 60, rate: float = 0.3, decay: float = 0.02) -> Crf:
    """Log-likelihood ascent with adaptive steps over the labelled lines (by default the module's table)."""
    feats, y, rows = _training_rows(list(lines) if lines is not None else labelled_lines())
    mask = _step_mask()
    w, step = np.zeros((len(_AROUND) * _SLOTS, _N, _LABELS), dtype=np.float32), np.zeros((_LABELS, _LABELS))
    grown, step_grown = np.full(w.shape, 1e-2, dtype=np.float32), np.full(step.shape, 1e-2)
    used = []
    for i, d in enumerate(_AROUND):
        there = np.clip(np.arange(len(y)) + d, 0, len(y) - 1)
        same = (rows[there] == rows) & (there == np.arange(len(y)) + d)
        for k in range(_SLOTS):
            ids, inverse = np.unique(feats[there[same], k], return_inverse=True)
            used.append((_SLOTS * i + k, np.flatnonzero(same), ids, inverse))
    for _ in range(rounds):
        _, by_emit, by_step = log_likelihood(Crf(w, step).emissions(feats, rows), step + mask, y, rows)
        by_step = np.where(mask < 0, 0.0, by_step - decay * step)
        step_grown += by_step**2
        step = step + rate * by_step / np.sqrt(step_grown)
        for table, tokens, ids, inverse in used:
            total = np.zeros((len(ids), _LABELS))
            np.add.at(total, inverse, by_emit[tokens])
            total -= decay * w[table][ids]
            grown[table][ids] += total**2
            w[table][ids] += rate * total / np.sqrt(grown[table][ids])
    return Crf(w, step + mask)


def added_spans(data: np.ndarray, offsets: np.ndarray, crf: Crf) -> dict[int, list[tuple[str, int, int]]]:
    """The CRF's spans by document number, as (kind, start, end) in bytes of the document; a line is a sequence."""
    out: dict[int, list[tuple[str, int, int]]] = {}
    for x, y in blocks(offsets, _BLOCK):
        lo, hi = offsets[x], offsets[y]
        part, offs = data[lo:hi], offsets[x : y + 1] - lo
        s, e, doc, a, b = pii_tokens(part, offs)
        if not len(s):
            continue
        line = np.cumsum(part == 10, dtype=np.int64)[s] * (y - x + 1) + doc
        tags = decode(crf.emissions(token_features(part, s, e, a, b, line), line), line, crf.step)
        hit = np.flatnonzero(tags)
        begins = hit[tags[hit] % 2 == 1]
        if not len(begins):
            continue
        # A span ends before the next token that does not follow.
        stops = np.flatnonzero((tags == 0) | (tags % 2 == 1))
        after = np.searchsorted(stops, begins, side="right")
        ends = np.where(after < len(stops), stops[np.minimum(after, len(stops) - 1)], len(tags)) - 1
        for i, j in zip(begins.tolist(), ends.tolist(), strict=True):
            k = int(doc[i])
            out.setdefault(x + k, []).append((_KINDS[(int(tags[i]) - 1) // 2], int(a[i] - offs[k]), int(b[j] - offs[k])))
    return out


def all_spans(texts: list[str], data: np.ndarray, offsets: np.ndarray, crf: Crf) -> Iterator[tuple[list, list]]:
    """(base spans, all spans) of each text in code points; the CRF's spans yield to base ones they touch."""
    added = added_spans(data, offsets, crf)
    for i, text in enumerate(texts):
        base = base_spans(text)
        every = base
        if i in added:
            raw = data[offsets[i] : offsets[i + 1]]
            point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            starts = [x for _, x, _ in base]
            reach = np.maximum.accumulate([y for _, _, y in base]) if base else []
            extra = []
            for kind, a, b in added[i]:
                a, b = int(point[a]), int(point[b])
                k = bisect_left(starts, b)  # base spans that begin before the end
                if not k or reach[k - 1] <= a:
                    extra.append((kind, a, b))
            every = sorted(base + extra, key=lambda s: (s[1], KINDS.index(s[0])))
        yield base, every


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_secret, n_person, n_address, base_sha256, spans of every row of ``docs``.

    Whole texts are read; a null text counts as empty and has no spans.  Repeated rows
    give repeated results; a null doc_id stays null.  Columns other than doc_id and text
    are not read.  An empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(train_crf())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts: tuple[list, ...] = tuple([] for _ in KINDS)
            sums, spans = [], []
            for base, every in all_spans(texts, data, offsets, held.value):
                for kind, column in zip(KINDS, counts, strict=True):
                    column.append(sum(s[0] == kind for s in every))
                sums.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(tidy(run), "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of touching spans replaced by the first one's kind, as in ``[EMAIL]``."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars`` (if there) counted anew where it changed.

    A null text stays null; all other columns and rows stay as they are.
    """
    held = docs.sparkSession.sparkContext.broadcast(train_crf())
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            data, offsets = text_buffers(batch.column(at))
            old = batch.column(at).to_pylist()
            found = all_spans([t or "" for t in old], data, offsets, held.value)
            new = [t if t is None or not every else redact(t, every) for t, (_, every) in zip(old, found, strict=True)]
            columns = dict(zip(names, batch.columns, strict=True))
            columns["text"] = pa.array(new, batch.column(at).type)
            if "n_chars" in columns:
                size = columns["n_chars"]
                columns["n_chars"] = pa.array([n if t is o or t is None else len(t) for n, t, o in zip(size.to_pylist(), new, old, strict=True)], size.type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return docs.mapInArrow(tidy(run), schema)
