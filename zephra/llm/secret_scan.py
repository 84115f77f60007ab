"""Secret scan: fixed forms plus a linear-chain conditional random field.

The field tags tokens (runs of ``[A-Za-z0-9+/_-]``, or single other signs) as begin, inside or outside of a secret, from their
shape, the words and signs around them and features of the file. Its chains are the lines of the text, each with all its
tokens: no token of a text is left out. Texts are tagged by groups of ``GROUP`` characters, all lines of a group at once. Viterbi finds the
best tags, without its steps where a bound proves them to be outside throughout; a tagged span of ``LEAST`` characters is reported as kind ``field`` if its posterior probability,
from the forward and backward sums of its chain, is at least ``POSTERIOR``. A ``field`` span marks the secret itself, so it may
lie inside a longer fixed form or equal one. Spans of the fixed forms always stay.

The field is fitted in one task to at most ``MAX_FITTED`` documents (least hash of doc_id, of those with a digit), each as it is
and in ``COPIES`` altered forms: there the announcing word of a secret is often taken away and its value often drawn anew
from another alphabet, so that shape and context must tell it. Of a document it learns from the pieces of lines around tokens
that could be a secret (a digit among 8 signs, or 20 signs; ``AROUND`` characters on either side) and from ``PLAIN`` other
stretches of ``MAX_CHAIN`` tokens at most. Tokens outside the fixed forms that look like secrets are of
unknown tag: the likelihood sums over their tags instead of teaching them as outside.

Positions are code points, end exclusive. Defined results: NULL equals an empty text and has no span. Without any fixed form
in the sample nothing is fitted and no ``field`` span added. Each row is handled by itself: ties and repeated rows get equal
results, an empty table gives no rows, and columns other than doc_id and text do not take part.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
import string
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zephra.llm.catalog import query, table

MAX_FITTED = 2000
COPIES = 4
LEAST = 12
POSTERIOR = 0.5
AROUND = 120
DIMS = 1 << 12
STEPS = 120
RATE = 0.1
RIDGE = 2e-4
MAX_CHAIN = 64  # longer chains are cut for fitting only
PLAIN = 1
GROUP = 1 << 21
DENSE = 1 << 22  # values below this are numbered through a table, others by sorting
OUT, BEGIN, INSIDE = 0, 1, 2
KINDS = ["assign", "access", "hex", "field"]
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_STARTS = ["passw", "secret", "token", "api"]  # one of them, in small letters, is in every match
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]+|[^\sA-Za-z0-9+/_-]")
_WITH_DIGIT = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z+/_-]*+[0-9][A-Za-z0-9+/_-]*+")
_LONG = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+")
# Words that announce a secret, and beginnings of issued keys.
_CUE_WORDS = [b"password", b"passwd", b"pwd", b"secret", b"token", b"api", b"key", b"auth", b"bearer", b"credential", b"private", b"passphrase"]
_CUES = re.compile("(?i)" + "|".join(x.decode() for x in _CUE_WORDS))
_ISSUED = re.compile(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abps]-|eyJ|AIza|glpat-")
_ISSUED_PAIRS = [ord(x[0]) << 21 | ord(x[1]) for x in ("AK", "AS", "gh", "sk", "xo", "ey", "AI", "gl")]
#: Kinds of characters; those from digits on make up tokens, a sign is one by itself. No white space is beyond the table.
_SPACE, _SIGN, _DIGIT, _SMALL, _CAPITAL, _JOINER = range(6)
_KINDS = np.array([_SPACE if chr(c).isspace() else _SIGN for c in range(0x3002)], dtype=np.uint8)
for _c in string.printable:
    if _c.isalnum() or _c in "+/_-":
        _KINDS[ord(_c)] = _DIGIT if _c.isdigit() else _SMALL if _c.islower() else _CAPITAL if _c.isupper() else _JOINER
#: A bit for each kind within tokens, and one for each character within tokens; number 128 stands for all others.
_BITS = np.array([0, 0, 1, 2, 4, 8], dtype=np.uint8)
_LETTER_BITS, _OTHER_BITS, _LOWER = np.zeros(129, dtype=np.uint64), np.zeros(129, dtype=np.uint8), np.zeros(129, dtype=np.uint8)
for _k, _c in enumerate(string.ascii_letters + string.digits):
    _LETTER_BITS[ord(_c)], _LOWER[ord(_c)] = 1 << _k, ord(_c.lower())
for _k, _c in enumerate("+/_-"):
    _OTHER_BITS[ord(_c)] = 1 << _k
_HEX_RUN = re.compile(r"[0-9a-f]{32,}")
_ALPHABETS = [
    "0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-",
]
_LETTERS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]
_ANNOUNCED = ["password", "passphrase", "secret", "token", "api_key", "auth", "Bearer", "credential", "private key"]
_OPENINGS = [" = \"", ": ", "=", " ", ": \"", ":", "='"]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Fixed forms by start, then kind."""
    found, lower = [], text.lower()
    if any(x in lower for x in _ASSIGN_STARTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # A run of hexadecimal letters is the same whether short ones are matched and dropped or passed over.
    found += [("hex", m.start(), m.end()) for m in _HEX_RUN.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def values(text: str) -> list[tuple[int, int]]:
    """The secrets themselves of the fixed forms: values of assignments, and other forms outside them."""
    out = [m.span(1) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(a, b) for k, a, b in base_spans(text) if k != "assign" and not any(x <= a and b <= y for x, y in out)]
    return sorted(out)


def pieces(text: str) -> list[tuple[int, int]]:
    """The parts of lines around tokens that could be a secret, in order and apart."""
    found = sorted({m.span() for r in (_WITH_DIGIT, _LONG) for m in r.finditer(text) if m.end() - m.start() >= 8})
    out: list[list[int]] = []
    for a, b in found:
        lo = max(text.rfind("\n", max(0, a - AROUND), a) + 1, a - AROUND, 0)
        hi = text.find("\n", b, b + AROUND)
        hi = min(len(text), b + AROUND) if hi < 0 else hi
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


@functools.lru_cache(maxsize=1 << 17)
def _number(name: str) -> int:
    return xxhash.xxh32_intdigest(name.encode("utf-8", "surrogatepass")) & (DIMS - 1)


N_FEATURES = 17


def _shape(w: str) -> list[str]:
    """Names of the features of a token by itself."""
    n = len(w)
    digits = sum("0" <= c <= "9" for c in w)
    lower, upper = any("a" <= c <= "z" for c in w), any("A" <= c <= "Z" for c in w)
    kinds = ["0" if "0" <= c <= "9" else "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "-" for c in w]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:]))
    run = max((len(r) for r in re.findall("[A-Za-z]+", w)), default=0)
    look = min(n // 4, 8), digits > 0, lower, upper, not w.isalnum(), 4 * digits // n, 4 * len(set(w)) // n, min(8, 16 * turns // n), min(run, 9)
    return _shape_names(*look, _ISSUED.match(w) is not None)


#: Values of the arguments of ``_shape_names``, each from 0.
_LOOKS = (9, 2, 2, 2, 2, 5, 5, 9, 10, 2)


def _shape_names(size: int, digit: int, lower: int, upper: int, sign: int, digits: int, different: int, turns: int, run: int, issued: int) -> list[str]:
    kind, long = f"{'d' if digit else ''}{'l' if lower else ''}{'u' if upper else ''}{'s' if sign else ''}", size >= 3
    return [
        f"n{size}", f"k{kind}", f"nk{size}{kind}", f"r{digits}{size}", f"v{different}{size}", f"t{turns}{long}", f"a{run}{long}", f"i{bool(issued)}",
    ]


def _sign(w: str) -> str:
    return w if len(w) == 1 and not w.isalnum() else "9" if w.isdigit() else "a" if w.isalpha() else "x" if w else ""


def chain(text: str, lo: int, hi: int, file: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(tokens with places in the text, hashed features of each) of one piece."""
    spans = [(a + lo, b + lo) for a, b in (m.span() for m in _TOKEN.finditer(text[lo:hi]))]
    words = [text[a:b] for a, b in spans]
    signs = ["", "", *map(_sign, words), "", ""]
    cues = [bool(_CUES.search(w)) for w in words]
    rows = []
    for i, (w, (a, _)) in enumerate(zip(words, spans, strict=True)):
        before, before2, after, after2 = signs[i + 1], signs[i], signs[i + 3], signs[i + 4]
        cue, long = any(cues[max(0, i - 3) : i]), len(w) >= 12
        joined = i > 0 and spans[i - 1][1] == a
        names = [
            *_shape(w), f"p{before}{long}", f"pp{before2}{before}{long}", f"x{after}{long}", f"xx{after}{after2}{long}",
            f"px{before}{after}{long}", f"c{cue}", f"cl{cue}{long}", f"j{joined}{w if len(w) == 1 else ''}", f"f{file}{long}",
        ]
        rows.append([_number(x) for x in names])
    return spans, np.array(rows, dtype=np.int32).reshape(-1, N_FEATURES)


def _file(text: str) -> str:
    """Kind of file: how common assignments and digits are in it."""
    n = max(1, len(text))
    return f"{min(3, text.count('=').bit_length())}{int(20 * sum(map(text.count, '0123456789')) / n)}"


def altered(text: str, rnd: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """The text with its secrets announced and written in another way, and where they are now."""
    out, secrets, at, size = [], [], 0, 0
    starts = {m.span(1): m.start() for m in ASSIGN.finditer(text)}
    words = re.findall(r"[^\W\d_]{3,}", text[:2000]) or ["value"]

    def put(piece: str) -> None:
        nonlocal size
        out.append(piece)
        size += len(piece)

    for a, b in values(text):
        start = starts.get((a, b), a)
        if start < at:
            continue
        put(text[at:start])
        kind, value = rnd.random(), text[a:b]
        if start < a:
            put(text[start:a] if kind < 0.2 else rnd.choice(_ANNOUNCED if kind < 0.5 else words) + rnd.choice(_OPENINGS))
        if start < a and 0.2 <= kind < 0.4:  # announced, so it may look like a word with some digits
            letters = rnd.choice(_LETTERS)
            value = "".join(rnd.choice("0123456789") if rnd.random() < 0.12 else rnd.choice(letters) for _ in range(rnd.randint(14, 32))) + rnd.choice("0123456789")
        elif rnd.random() < 0.8:
            letters = rnd.choice(_ALPHABETS)
            value = "".join(rnd.choice(letters) for _ in range(rnd.randint(16, 48)))
        secrets.append((size, size + len(value)))
        put(value)
        at = b + (text[b : b + 1] in ("'", '"') and out[-2][-1:] not in ("'", '"'))  # a closing quote goes with the opening one
    put(text[at:])
    return "".join(out), secrets


def _tags(text: str, spans: list[tuple[int, int]], secrets: list[tuple[int, int]]) -> list[int]:
    """Tag of each token; -1 if unknown: of the look of a secret, with letters, outside the fixed forms."""
    tags, last = [], None
    for a, b in spans:
        hit = next((s for s in secrets if s[0] <= a and b <= s[1]), None)
        w = text[a:b]
        unknown = b - a >= LEAST and any("0" <= c <= "9" for c in w) and any(c.isalpha() for c in w)
        tags.append((INSIDE if hit == last else BEGIN) if hit is not None else -1 if unknown else OUT)
        last = hit
    return tags


def _plain(text: str, rnd: random.Random) -> list[tuple[list[tuple[int, int]], np.ndarray]]:
    """Chains of stretches of lines that ``pieces`` leaves out."""
    ends = [(0, 0), *pieces(text), (len(text), len(text))]
    gaps = [(a, b) for (_, a), (b, _) in zip(ends, ends[1:]) if b - a >= LEAST]
    out = []
    for a, b in rnd.sample(gaps, min(PLAIN, len(gaps))):
        at = rnd.randrange(a, b)
        lo = max(a, text.rfind("\n", a, at) + 1)
        if at - lo > 8 * MAX_CHAIN:
            lo = text.rfind(" ", lo, at) + 1 or at
        hi = text.find("\n", at, b)
        spans, x = chain(text, lo, min(b if hi < 0 else hi, lo + 16 * MAX_CHAIN), _file(text))
        if spans:
            out.append((spans[:MAX_CHAIN], x[:MAX_CHAIN]))
    return out


def examples(text: str, copies: int = COPIES) -> list[tuple[np.ndarray, list[int]]]:
    """(features, tags) of the chains of a text and of its altered copies."""
    rnd = random.Random(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))
    forms = [(text, values(text))]
    if forms[0][1]:
        forms += [altered(text, rnd) for _ in range(copies)]
    out = [(x, _tags(text, spans, forms[0][1])) for spans, x in _plain(text, rnd)]
    for form, secrets in forms:
        file = _file(form)
        for lo, hi in pieces(form):
            spans, x = chain(form, lo, hi, file)
            y = _tags(form, spans, secrets)
            out += [(x[i : i + MAX_CHAIN], y[i : i + MAX_CHAIN]) for i in range(0, len(y), MAX_CHAIN)]
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


#: An inside tag follows a begin or inside tag; chains start and end outside.
_ALLOWED = np.array([[0.0, 0.0, -30.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])


def sums(e: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward, backward, total) log sums of chains of equal length: e is chains x tokens x tags."""
    a, b = np.empty_like(e), np.empty_like(e)
    n = e.shape[1]
    a[:, 0] = e[:, 0] + move[OUT]
    for i in range(1, n):
        a[:, i] = e[:, i] + _log_sum(a[:, i - 1, :, None] + move[None], 1)
    b[:, n - 1] = move[:, OUT]
    for i in range(n - 2, -1, -1):
        b[:, i] = _log_sum(move[None] + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2)
    return a, b, _log_sum(a[:, -1] + b[:, -1], 1)


def _expected(e: np.ndarray, move: np.ndarray, live: np.ndarray, before: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tag probabilities, expected moves summed over chains) by sums that are scaled at each token.

    ``e`` is tags x tokens: the first tokens of all chains, longest chain first, then the second ones, and so on; ``live`` tells how
    many there are of each. ``before`` is the place of the token before each but the first ones, ``last`` that of the last ones.
    """
    x, m = np.exp(e - e.max(axis=0)), np.exp(move)
    a, b, scale = np.empty_like(x), np.empty_like(x), np.ones(x.shape[1])
    at = np.concatenate([[0], np.cumsum(live)]).tolist()
    live = live.tolist()
    a[:, : live[0]] = x[:, : live[0]] * m[OUT][:, None]
    for i in range(1, len(live)):
        part = slice(at[i], at[i + 1])
        now = (m[:, :, None] * a[:, None, at[i - 1] : at[i - 1] + live[i]]).sum(axis=0) * x[:, part]
        a[:, part] = now / now.sum(axis=0)
    b[:, last] = m[:, OUT][:, None]
    for i in range(len(live) - 2, -1, -1):
        part, after = slice(at[i], at[i] + live[i + 1]), slice(at[i + 1], at[i + 2])
        now = (m[:, :, None] * (x[:, after] * b[:, after])[None]).sum(axis=1)
        scale[part] = now.sum(axis=0)
        b[:, part] = now / scale[part]
    p = a * b
    total = p.sum(axis=0)
    p /= total
    moves = np.zeros((3, 3))
    moves[OUT] += p[:, : live[0]].sum(axis=1)
    moves[:, OUT] += p[:, last].sum(axis=1)
    left, right = (a / (total * scale))[:, before], (x * b)[:, live[0] :]
    return p, moves + m * np.array([[(one * other).sum() for other in right] for one in left])


def fit_field(data: list[tuple[np.ndarray, list[int]]], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(DIMS x 3 emission weights, 3 x 3 moves) by Adam on the likelihood of the known tags.

    Tokens with the same features share one sum of weights. The chains advance token by token at once.
    """
    chains = sorted((d for d in data if len(d[1])), key=lambda d: -len(d[1]))
    sizes = np.array([len(y) for _, y in chains])
    first = np.cumsum(sizes) - sizes
    live = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # chains of more than i tokens
    order = np.concatenate([first[:k] + i for i, k in enumerate(live.tolist())])
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    last, before = place[first + sizes - 1], place[order[live[0] :] - 1]
    used, row = np.unique(np.concatenate([f for f, _ in chains]).astype(np.int64), axis=0, return_inverse=True)
    row = row.reshape(-1)[order]
    tags = np.concatenate([y for _, y in chains])[order]
    known = np.where((tags < 0) | (tags == np.arange(3)[:, None]), 0.0, -1e4)
    w, t = np.zeros((DIMS, 3)), np.zeros((3, 3))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    for step in range(1, steps + 1):
        move = t + _ALLOWED
        e = w[used].sum(axis=1).T[:, row]
        p, moves = _expected(e, move, live, before, last)
        q, seen = _expected(e + known, move, live, before, last)
        diff = (q - p) / len(data)
        gw = -RIDGE * w
        for k in range(3):
            each = np.bincount(row, weights=diff[k], minlength=len(used))
            gw[:, k] += np.bincount(used.ravel(), weights=np.repeat(each, N_FEATURES), minlength=DIMS)
        gt = (seen - moves) / len(data) - RIDGE * t
        for k, (par, g) in enumerate(((w, gw), (t, gt))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            par += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w, t


def viterbi(e: np.ndarray, move: np.ndarray) -> list[int]:
    """Best tags of a chain."""
    best = e[0] + move[OUT]
    back = []
    for i in range(1, len(e)):
        through = best[:, None] + move
        back.append(through.argmax(axis=0))
        best = through.max(axis=0) + e[i]
    tags = [int((best + move[:, OUT]).argmax())]
    for step in reversed(back):
        tags.append(int(step[tags[-1]]))
    return tags[::-1]


def likely_spans(e: np.ndarray, move: np.ndarray, tags: list[int], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Tagged spans of a chain with enough characters and probability."""
    a, b, z = (v[0] for v in sums(e[None], move))
    return _probable(a, b, z, e, move, tags, spans)


def _probable(a: np.ndarray, b: np.ndarray, z: float, e: np.ndarray, move: np.ndarray, tags: list[int], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``likely_spans`` of a chain whose sums are known."""
    found = []
    for i, tag in enumerate(tags):
        if tag != BEGIN:
            continue
        end, score, last = i + 1, a[i, BEGIN], BEGIN
        while end < len(tags) and tags[end] == INSIDE:
            score, last, end = score + move[last, INSIDE] + e[end, INSIDE], INSIDE, end + 1
        rest = [move[last, k] + e[end, k] + b[end, k] for k in (OUT, BEGIN)] if end < len(tags) else [move[last, OUT]]
        score += float(np.logaddexp.reduce(rest))
        if spans[end - 1][1] - spans[i][0] >= LEAST and score - z >= np.log(POSTERIOR):
            found.append((spans[i][0], spans[end - 1][1]))
    return found


def _weights(names: Iterable[list[str]], w: np.ndarray) -> np.ndarray:
    """Sums of the weights of each list of features."""
    return np.array([w[[_number(x) for x in row]].sum(axis=0) for row in names]).reshape(-1, 3)


def _different(key: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The different values of ``key``, all below ``limit``, in order, and the number of each value among them."""
    if limit > DENSE:
        return np.unique(key, return_inverse=True)
    seen, number = np.zeros(limit, dtype=bool), np.zeros(limit, dtype=np.int32)
    seen[key] = True
    different = np.flatnonzero(seen)
    number[different] = np.arange(len(different))
    return different, number[key]


def _summed(parts: list[tuple[np.ndarray, int]], names: Callable[..., list[str]], w: np.ndarray) -> np.ndarray:
    """Per token the sum of the weights of ``names`` of its values of ``parts``, each below its limit; named once for equal values."""
    key, limit = np.zeros(len(parts[0][0]), dtype=np.int64), 1
    for values, below in parts:
        key *= below
        key += values
        limit *= below
    different, back = _different(key, limit)
    values = []
    for _, below in reversed(parts):
        different, value = np.divmod(different, below)
        values.append(value.tolist())
    return _weights(map(names, *reversed(values)), w)[back]


class _Tokens:
    """Tokens of the lines of many texts, and what the features of each one by itself depend on.

    ``start`` and ``end`` are places in the texts joined by line ends. ``look`` has the arguments of ``_shape_names``; ``sign`` numbers
    ``signs``, what ``_sign`` gives, and ``single`` numbers ``singles``, the tokens of one character. Number 0 is the empty string.
    """

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = _KINDS[np.minimum(codes, len(_KINDS) - 1)]
        within, lone = kind >= _DIGIT, kind == _SIGN
        both = within[1:] & within[:-1]
        begins, closes = within | lone, within | lone
        begins[1:] &= ~both
        closes[:-1] &= ~both
        self.start = start = np.flatnonzero(begins)
        self.end = np.flatnonzero(closes) + 1
        if not len(start):
            return
        self.line = np.cumsum(codes == 10, dtype=np.int32)[start]
        size = self.end - start
        self.long = size >= 12

        def total(flags: np.ndarray) -> np.ndarray:
            """Number of set flags of each token; flags between tokens are never set."""
            return np.add.reduceat(flags, start, dtype=np.int32)

        has = np.bitwise_or.reduceat(_BITS[kind], start)
        small = np.minimum(codes, 128)
        different = np.bitwise_count(np.bitwise_or.reduceat(_LETTER_BITS[small], start)) + np.bitwise_count(np.bitwise_or.reduceat(_OTHER_BITS[small], start))
        different[lone[start]] = 1
        turned = np.zeros(len(codes), dtype=bool)
        turned[1:] = both & (kind[1:] != kind[:-1])
        letter = kind >= _SMALL
        letter &= kind <= _CAPITAL
        edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
        runs = np.zeros(len(codes), dtype=np.int32)
        opens = np.flatnonzero(edge == 1)
        runs[opens] = np.flatnonzero(edge == -1) - opens
        # Signs and single characters as Python sees them, once for each different one.
        one = np.flatnonzero(size == 1)
        chars, back = _different(codes[start[one]], 0x110000)
        chars = [chr(c) for c in chars.tolist()]
        alnum = (has & _BITS[_JOINER]) == 0
        alnum[one] = np.array([c.isalnum() for c in chars], dtype=bool)[back]
        self.singles = ["", *chars]
        self.single = np.zeros(len(start), dtype=np.int32)
        self.single[one] = back + 1
        known = {name: k for k, name in enumerate(["", "9", "a", "x"])}
        number = np.array([known.setdefault(_sign(c), len(known)) for c in chars], dtype=np.int32)
        self.signs = list(known)
        self.sign = np.where(has == _BITS[_DIGIT], 1, np.where(alnum & (has & _BITS[_DIGIT] == 0), 2, 3)).astype(np.int32)
        self.sign[one] = number[back]
        issued = np.zeros(len(start), dtype=bool)
        pair = codes[start].astype(np.int64) << 21
        pair[size > 1] += codes[start[size > 1] + 1]
        for k in np.flatnonzero(np.isin(pair, _ISSUED_PAIRS)).tolist():
            issued[k] = _ISSUED.match(joined, start[k]) is not None  # of signs within tokens, so it ends in this one
        self.cue = np.zeros(len(start), dtype=bool)
        lower, places = _LOWER[small].tobytes(), []
        for word in _CUE_WORDS:
            at = lower.find(word)
            while at >= 0:
                places.append(at)
                at = lower.find(word, at + 1)
        self.cue[np.searchsorted(start, places, side="right") - 1] = True
        self.look = [
            np.minimum(size // 4, 8), has & _BITS[_DIGIT] > 0, has & _BITS[_SMALL] > 0, has & _BITS[_CAPITAL] > 0, ~alnum,
            4 * total(kind == _DIGIT) // size, 4 * different.astype(np.int64) // size, np.minimum(16 * total(turned) // size, 8),
            np.minimum(np.maximum.reduceat(runs, start), 9), issued,
        ]


def _emissions(tokens: _Tokens, joined: np.ndarray, files: list[str], file: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Tokens x tags: what ``w[chain(...)].sum`` gives, from one sum for each different look and each different surrounding.

    ``file`` is the number of each token's kind of file.
    """
    line, signs, long = tokens.line, tokens.signs, tokens.long
    # Signs before and after within the line, number 0 beyond its ends.
    n = len(line)
    around = {}
    cued = np.zeros(n, dtype=bool)
    for d in (1, 2, 3):
        same = line[d:] == line[:-d]
        cued[d:] |= same & tokens.cue[:-d]
        if d < 3:
            around[-d], around[d] = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
            around[-d][d:] = np.where(same, tokens.sign[:-d], 0)
            around[d][:-d] = np.where(same, tokens.sign[d:], 0)
    m = len(signs)
    yes = [False, True]
    e = _summed(list(zip(tokens.look, _LOOKS, strict=True)), _shape_names, w)
    e += _summed([(around[-2], m), (around[-1], m), (long, 2)], lambda q, p, g: [f"p{signs[p]}{yes[g]}", f"pp{signs[q]}{signs[p]}{yes[g]}"], w)
    e += _summed([(around[1], m), (around[2], m), (long, 2)], lambda x, y, g: [f"x{signs[x]}{yes[g]}", f"xx{signs[x]}{signs[y]}{yes[g]}"], w)
    e += _summed([(around[-1], m), (around[1], m), (long, 2)], lambda p, x, g: [f"px{signs[p]}{signs[x]}{yes[g]}"], w)
    e += _summed([(cued, 2), (long, 2)], lambda c, g: [f"c{yes[c]}", f"cl{yes[c]}{yes[g]}"], w)
    e += _summed([(joined, 2), (tokens.single, len(tokens.singles))], lambda j, o: [f"j{yes[j]}{tokens.singles[o]}"], w)
    return e + _summed([(file, len(files)), (long, 2)], lambda f, g: [f"f{files[f]}{yes[g]}"], w)


def _may_be_tagged(e: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Whether the best tags of each chain may be others than outside throughout; where not, ``viterbi`` need not be run.

    Against outside throughout, a run of m tagged tokens gains at most its tokens' gains, m - 1 moves within and two at its ends.
    """
    moves = move - move[OUT, OUT]
    within = moves[1:, 1:].max()
    gain = np.maximum(e[:, BEGIN], e[:, INSIDE]) - e[:, OUT] + within
    ends = moves[OUT, 1:].max() + moves[1:, OUT].max() - within
    # One run gains no more than all the tokens that gain, or the best one if none does; some run of a better path gains.
    best, total = np.maximum.reduceat(gain, first), np.add.reduceat(np.maximum(gain, 0.0), first)
    return np.where(best > 0, total, best) + ends > -1e-6


def _best_tags(e: np.ndarray, first: np.ndarray, size: np.ndarray, move: np.ndarray) -> np.ndarray:
    """``viterbi`` of many chains at once; chain k has the tokens from first[k], size[k] of them."""
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    tags = np.empty(len(e), dtype=np.int8)
    back = np.empty((len(e), 3), dtype=np.int8)
    live = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # chains of more than i tokens
    best = e[first] + move[OUT]
    for i in range(1, int(size[0])):
        k = int(live[i])
        through = best[:k, :, None] + move[None]
        at = first[:k] + i
        back[at] = through.argmax(axis=1)
        best[:k] = through.max(axis=1) + e[at]
    tag = (best + move[:, OUT]).argmax(axis=1)
    for i in range(int(size[0]) - 1, -1, -1):
        k = int(live[i])
        at = first[:k] + i
        tags[at] = tag[:k]
        if i:
            tag[:k] = back[at, tag[:k]]
    return tags


def _sums(e: np.ndarray, first: np.ndarray, size: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``sums`` of many chains at once; chain k has the tokens from first[k], size[k] of them, longer chains first."""
    a, b = np.empty_like(e), np.empty_like(e)
    live = np.searchsorted(-size, -np.arange(int(size[0]) + 1), side="left").tolist()
    a[first] = e[first] + move[OUT]
    for i in range(1, int(size[0])):
        at = first[: live[i]] + i
        a[at] = e[at] + _log_sum(a[at - 1][:, :, None] + move[None], 1)
    last = first + size - 1
    b[last] = move[:, OUT]
    for i in range(int(size[0]) - 1, 0, -1):
        at = first[: live[i]] + i
        b[at - 1] = _log_sum(move[None] + (e[at] + b[at])[:, None, :], 2)
    return a, b, _log_sum(a[last] + b[last], 1)


def _group_spans(texts: list[str], w: np.ndarray, t: np.ndarray) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    tokens = _Tokens(texts)
    start, end = tokens.start, tokens.end
    if not len(start):
        return out
    offset = np.cumsum([0, *(len(x) + 1 for x in texts)])
    numbers: dict[str, int] = {}
    file = np.array([numbers.setdefault(_file(x), len(numbers)) for x in texts], dtype=np.int32)
    owner = np.searchsorted(offset, start, side="right") - 1
    joined = np.zeros(len(start), dtype=bool)
    joined[1:] = end[:-1] == start[1:]
    move = t + _ALLOWED
    e = _emissions(tokens, joined, list(numbers), file[owner], w)
    first = np.flatnonzero(np.r_[True, tokens.line[1:] != tokens.line[:-1]])
    size = np.diff(np.r_[first, len(start)])
    some = _may_be_tagged(e, first, move)
    if not some.any():
        return out
    first, size = first[some], size[some]
    tags = _best_tags(e, first, size, move)
    some = np.array([(tags[a : a + n] == BEGIN).any() for a, n in zip(first.tolist(), size.tolist(), strict=True)])
    if not some.any():
        return out
    first, size = first[some], size[some]
    order = np.argsort(-size, kind="stable")
    a, b, z = _sums(e, first[order], size[order], move)
    total = np.empty_like(z)
    total[order] = z
    for at, n, z in zip(first.tolist(), size.tolist(), total.tolist(), strict=True):
        part, k = slice(at, at + n), int(owner[at])
        places = list(zip((start[part] - offset[k]).tolist(), (end[part] - offset[k]).tolist(), strict=True))
        out[k] += _probable(a[part], b[part], z, e[part], move, tags[part].tolist(), places)
    return out


def spans_of(texts: list[str], w: np.ndarray, t: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per text the spans tagged as secrets with enough probability; every token of every line takes part."""
    out, group, size = [], [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= GROUP:
            out += _group_spans(group, w, t)
            group, size = [], 0
    return out + _group_spans(group, w, t)


def field_spans(text: str, w: np.ndarray, t: np.ndarray) -> list[tuple[int, int]]:
    """Spans tagged as secrets with enough probability."""
    return spans_of([text], w, t)[0]


def fit(docs: DataFrame, max_fitted: int = MAX_FITTED) -> tuple[np.ndarray, np.ndarray] | None:
    """The field from a bounded number of documents; None without a fixed form among them."""
    some = docs.select("doc_id", "text").filter(F.col("text").rlike("[0-9]"))
    order = [F.xxhash64("doc_id", F.length("text")).alias("_o"), F.xxhash64("text").alias("_t")]
    ids = some.select("doc_id", *order).orderBy("_o", "doc_id", "_t").limit(max_fitted).select("_o", "_t").distinct()
    rows = some.select("text", *order).join(F.broadcast(ids), ["_o", "_t"]).dropDuplicates(["_o", "_t"]).select("text")

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [ex for text in b["text"] for ex in examples(text)]
            if found:
                yield pd.DataFrame({"x": [x.ravel() for x, _ in found], "y": [y for _, y in found]})

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = [
            (np.asarray(x, dtype=np.int64).reshape(-1, N_FEATURES), [int(v) for v in y]) for b in batches for x, y in zip(b["x"], b["y"], strict=True)
        ]
        if any(tag > 0 for _, y in data for tag in y):
            w, t = fit_field(sorted(data, key=lambda d: (len(d[1]), d[0].tobytes(), d[1])))  # sums in a fixed order
            yield pd.DataFrame({"values": [np.concatenate([w.ravel(), t.ravel()])]})

    model = rows.mapInPandas(made, "x array<int>, y array<int>").repartition(1).mapInPandas(fitted, "values array<double>").collect()
    if not model:
        return None
    flat = np.array(model[0][0])
    return flat[: 3 * DIMS].reshape(DIMS, 3), flat[3 * DIMS :].reshape(3, 3)


def scan(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) per row of ``docs``."""

    def listed(spans: list[tuple[str, int, int]]) -> str:
        return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            texts = [text or "" for text in batch["text"]]
            found = [[] for _ in texts] if model is None else spans_of(texts, *model)
            for doc_id, text, spans in zip(batch["doc_id"], texts, found, strict=True):
                base = base_spans(text)
                added = [("field", a, b) for a, b in spans]
                whole = sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0])))
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
                rows.append((doc_id, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(whole)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            yield out.astype({"doc_id": "Int64", "n_assign": "int64", "n_access": "int64", "n_hex": "int64"})

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInPandas(scanned, schema)


@query("op8_secrets")
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
