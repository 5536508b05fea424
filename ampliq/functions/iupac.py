"""Edit distance under IUPAC equality (bit-parallel, Myers 1999), as Arrow functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegerType, StructField, StructType

from .seq import IUPAC

DISTANCE = StructType([StructField("plain", IntegerType()), StructField("iupac", IntegerType())])


def equal_letters(rule: str) -> dict[str, str]:
    """Letters each letter equals besides itself.

    ``exact``: none. ``base``: an ambiguity code equals the bases it stands for.
    ``overlap``: two codes are equal when they share a base.
    """
    if rule == "exact":
        return {}
    if rule == "base":
        out = {x: set(bases) for x, bases in IUPAC.items() if len(bases) > 1}
        for x, bases in list(out.items()):
            for b in bases:
                out.setdefault(b, set()).add(x)
    else:
        out = {x: {y for y in IUPAC if set(IUPAC[x]) & set(IUPAC[y])} for x in IUPAC}
    return {x: "".join(sorted(y - {x})) for x, y in out.items()}


def match_masks(pattern: str, equal: dict[str, str]) -> dict[str, int]:
    """Bit i of ``masks[ch]`` says whether ``pattern[i]`` equals ``ch``."""
    spots: dict[str, int] = {}
    for ch in set(pattern):
        bits = int("".join("1" if x == ch else "0" for x in reversed(pattern)), 2)
        spots[ch] = bits
    masks = dict(spots)
    for ch, bits in spots.items():
        for other in equal.get(ch, ""):
            masks[other] = masks.get(other, 0) | bits
    return masks


def trim_common(a: str, b: str) -> tuple[str, str]:
    """Both strings without their common beginning and end, which never change a global distance."""

    def shared(x: str, y: str) -> int:
        lo, hi = 0, min(len(x), len(y))
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if x[lo:mid] == y[lo:mid]:
                lo = mid
            else:
                hi = mid - 1
        return lo

    n = shared(a, b)
    a, b = a[n:], b[n:]
    m = shared(a[::-1], b[::-1])
    return (a[: len(a) - m], b[: len(b) - m]) if m else (a, b)


def composition_bounds(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Lower bounds of the distances of pairs from letter counts; ambiguity codes may stand for anything."""
    counts = [np.array([[t.count(c) for c in b"ACGT"] for t in texts], np.int64).reshape(-1, 4) for texts in (x, y)]
    wild = sum(np.array([len(t) for t in texts], np.int64) - c.sum(axis=1) for texts, c in zip((x, y), counts))
    gap = counts[0] - counts[1]
    return np.maximum(np.maximum(gap, 0).sum(axis=1), np.maximum(-gap, 0).sum(axis=1)) - wild


def distance(a: str, b: str, equal: dict[str, str], infix: bool = False) -> int:
    """Global distance of ``a`` and ``b``; with ``infix`` the ends of ``b`` are free."""
    if not infix:
        a, b = trim_common(a, b)
    if not a:
        return 0 if infix else len(b)
    if not b:
        return len(a)
    masks = match_masks(a, equal)
    m = len(a)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = score
    carry = 0 if infix else 1
    for ch in b:
        eq = masks.get(ch, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = (ph << 1) | carry
        mh <<= 1
        plus = (mh | ~(xv | ph)) & full
        minus = ph & xv & full
    return best if infix else score


# -- many pairs at once ------------------------------------------------------------------------

#: Pairs with patterns of as many words go through the kernel together if there are this many of them for each word; for fewer, single big integers, which
#: the interpreter works on a word at a time too, cost less than the kernel's calls. Results are equal.
LANES_PER_WORD = 30
#: Entries of the match tables (pairs x words x letters) that are held at once.
TABLE = 1 << 21
#: Texts that meet one pattern side by side.
LANES = 4096
#: With fewer texts, or fewer than 3 for each word of the pattern, big integers cost less.
ALONE = 12
_ONE = np.uint64(1)
_BASE = np.full(256, -1)
_BASE[[ord(b) for b in "ACGT"]] = np.arange(4)


def letter_table(equal: dict[str, str]) -> np.ndarray:
    """Which bytes equal which."""
    table = np.eye(256, dtype=bool)
    for x, others in equal.items():
        for y in others:
            table[ord(x), ord(y)] = table[ord(y), ord(x)] = True
    return table


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in texts], np.int64)
    width = int(size.max(initial=0))
    return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width), size


def _lanes(x: list[bytes], y: list[bytes], table: np.ndarray, infix: bool, limit: np.ndarray) -> np.ndarray:
    """Distances of pairs with patterns ``x`` of the same number of words and texts ``y``, none empty: a letter of all texts at a time.

    A pair leaves when its text ends or its score, which a letter lowers by one
    at most, can no longer come down to its limit (then limit + 1 is returned).
    """
    order = np.argsort([-len(t) for t in y], kind="stable")
    pattern, m = _padded([x[k] for k in order])
    text, n = _padded([y[k] for k in order])
    limit = limit[order]
    words = int(-(-m.max() // 64))
    letters, place = np.unique(text, return_inverse=True)
    place = place.reshape(text.shape)
    inside = np.arange(pattern.shape[1]) < m[:, None]
    match = np.zeros((len(letters), words, len(x)), np.uint64)
    for k, letter in enumerate(letters):
        bits = np.zeros((len(x), words * 64), bool)
        bits[:, : pattern.shape[1]] = table[letter][pattern] & inside
        match[k] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).T
    top = _ONE << ((m - 1) % 64).astype(np.uint64)
    high = _ONE << np.uint64(63)
    plus = np.full((words, len(x)), ~np.uint64(0))
    minus = np.zeros((words, len(x)), np.uint64)
    score = m.copy()
    best = m.copy()
    out = np.empty(len(x), np.int64)
    lane = np.arange(len(x))
    first = 0 if infix else 1
    for j in range(text.shape[1]):
        live = len(lane) if n[lane[-1]] > j else int(np.searchsorted(-n[lane], -j, "left"))
        bounded = (score - (n[lane] - j) > limit[lane]) if not infix else None
        if live < len(lane) or (bounded is not None and j % 16 == 0 and bounded.any()):
            stay = np.arange(len(lane)) < live
            out[lane[~stay]] = (best if infix else score)[~stay]
            if bounded is not None:
                over = stay & bounded
                out[lane[over]] = limit[lane[over]] + 1
                stay &= ~over
            lane, score, best, plus, minus, match, top = lane[stay], score[stay], best[stay], plus[:, stay], minus[:, stay], match[:, :, stay], top[stay]
            if not len(lane):
                break
        eqs = match[place[lane, j], :, np.arange(len(lane))]
        up = np.full(len(lane), first, np.int64)
        for w in range(words):
            eq, pv, mv = eqs[:, w], plus[w], minus[w]
            down_in, up_in = (up < 0).astype(np.uint64), (up > 0).astype(np.uint64)
            xv = eq | mv
            eq = eq | down_in
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv)
            mh = pv & xh
            if w == words - 1:
                score = score + ((ph & top) != 0) - ((mh & top) != 0)
            else:
                up = ((ph & high) != 0).astype(np.int64) - ((mh & high) != 0)
            ph, mh = (ph << _ONE) | up_in, (mh << _ONE) | down_in
            plus[w] = mh | ~(xv | ph)
            minus[w] = ph & xv
        if infix:
            best = np.minimum(best, score)
    out[lane] = best if infix else score
    out = np.where(out > limit, limit + 1, out)
    back = np.empty(len(x), np.int64)
    back[order] = out
    return back


def _trimmed(x: list[bytes], y: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Pairs without their common beginnings and ends."""
    a, n = _padded(x)
    b, m = _padded(y)
    width = min(a.shape[1], b.shape[1])
    differs = np.concatenate([a[:, :width] != b[:, :width], np.ones((len(x), 1), bool)], axis=1)
    front = np.minimum(differs.argmax(axis=1), np.minimum(n, m))
    x, y = [t[k:] for t, k in zip(x, front.tolist())], [t[k:] for t, k in zip(y, front.tolist())]
    a, n = _padded([t[::-1] for t in x])
    b, m = _padded([t[::-1] for t in y])
    width = min(a.shape[1], b.shape[1])
    differs = np.concatenate([a[:, :width] != b[:, :width], np.ones((len(x), 1), bool)], axis=1)
    tail = np.minimum(differs.argmax(axis=1), np.minimum(n, m)).tolist()
    return [t[: len(t) - k] for t, k in zip(x, tail)], [t[: len(t) - k] for t, k in zip(y, tail)]


def distances(x: list[bytes], y: list[bytes], equal: dict[str, str], infix: bool = False, limit: np.ndarray | None = None) -> np.ndarray:
    """Global distances of many pairs of texts in single-byte letters; with ``infix`` the ends of ``y`` are free.

    ``limit`` (one for each pair): a larger distance may be given as limit + 1.
    Pairs whose lengths differ by more than their limit need no alignment.
    """
    out = np.zeros(len(x), np.int64)
    limit = np.full(len(x), 1 << 40) if limit is None else np.maximum(np.asarray(limit, np.int64), -1)
    table = letter_table(equal)
    todo = np.flatnonzero([a != b for a, b in zip(x, y)])
    for low in range(0, len(todo), 2_000):
        some = todo[low : low + 2_000]
        a, b = [x[k] for k in some], [y[k] for k in some]
        if not infix:
            a, b = _trimmed(a, b)
            # The distance is the same both ways, so the shorter text is the pattern.
            a, b = by_length(a, b)
        size, other = np.array([len(t) for t in a]), np.array([len(t) for t in b])
        words = -(-size // 64)
        got = np.where(size == 0, 0 if infix else other, size)
        if not infix:
            far = other - size > limit[some]
            got[far] = limit[some][far] + 1
        else:
            far = np.zeros(len(some), bool)
        for w in np.unique(words[(size > 0) & (other > 0) & ~far]).tolist():
            own = np.flatnonzero((words == w) & (size > 0) & (other > 0) & ~far)
            if len(own) < LANES_PER_WORD * w:
                got[own] = [distance(a[k].decode("latin-1"), b[k].decode("latin-1"), equal, infix) for k in own]
                continue
            # Texts of like lengths go together; at most 24 different letters are counted on.
            own = own[np.argsort(other[own], kind="stable")]
            step = max(16, TABLE // (24 * w))
            for k in range(0, len(own), step):
                part = own[k : k + step]
                got[part] = _lanes([a[i] for i in part], [b[i] for i in part], table, infix, limit[some][part])
        out[some] = np.minimum(got, limit[some] + 1)
    return out


def by_length(x: list[bytes], y: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Pairs with the shorter text first; of equal lengths the first one stays."""
    pairs = [(p, q) if len(p) <= len(q) else (q, p) for p, q in zip(x, y)]
    return [p for p, _ in pairs], [q for _, q in pairs]


def all_equal(x: list[bytes], y: list[bytes], equal: dict[str, str]) -> np.ndarray:
    """Which pairs have distance 0: equal lengths, and letters equal position by position."""
    out = np.array([len(a) == len(b) for a, b in zip(x, y)], bool)
    own = [k for k in np.flatnonzero(out).tolist() if x[k]]
    if own:
        flat = letter_table(equal)[np.frombuffer(b"".join([x[k] for k in own]), np.uint8), np.frombuffer(b"".join([y[k] for k in own]), np.uint8)]
        starts = np.concatenate([[0], np.cumsum([len(x[k]) for k in own])[:-1]])
        out[own] = np.logical_and.reduceat(flat, starts)
    return out


def ambiguous(texts: list[bytes]) -> np.ndarray:
    """Which texts hold letters other than A, C, G and T."""
    return np.array([bool(t.strip(b"ACGT")) and bool(t.translate(None, b"ACGT")) for t in texts], bool)


def _encoded(column: pa.Array) -> list[bytes]:
    """Texts in single-byte letters; letters beyond Latin-1 become one that equals nothing in a sequence."""
    return [(t or "").encode("latin-1", "replace") for t in column.to_pylist()]


def _pairwise(a: pa.Array, b: pa.Array, rule: str, infix: bool) -> tuple[pa.Array, pa.Array]:
    equal = equal_letters(rule)
    null = np.asarray(a.is_null()) | np.asarray(b.is_null())
    x, y = _encoded(a), _encoded(b)
    if infix:
        x, y = by_length(x, y)
    plain = distances(x, y, {}, infix)
    iupac = plain.copy()
    again = np.flatnonzero((plain > 0) & (ambiguous(x) | ambiguous(y)))
    if len(again):
        # Equality of codes only ever lowers the distance.
        iupac[again] = distances([x[k] for k in again], [y[k] for k in again], equal, infix, plain[again])
    return pa.array(plain, pa.int32(), mask=null), pa.array(iupac, pa.int32(), mask=null)


def edit_iupac(a, b, rule: str = "overlap", infix: bool = False) -> Column:
    """struct(plain, iupac): edit distances without and with IUPAC equality."""

    @arrow_udf(DISTANCE)
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(list(_pairwise(x, y, rule, infix)), names=["plain", "iupac"])

    return run(a, b)


def gram_bounds(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Lower bounds of global distances from lengths and counts of three-letter words.

    An edit changes at most three words of either text, and an ambiguous letter,
    which may stand for others, spoils three of its own text and meets three.
    """
    sizes, profiles, unclear = [], [], 0
    for texts in (x, y):
        size = np.array([len(t) for t in texts], np.int64)
        code = _BASE[np.frombuffer(b"".join(texts), np.uint8)]
        owner = np.repeat(np.arange(len(texts)), size)
        word = code[:-2] * 16 + code[1:-1] * 4 + code[2:] if len(code) > 2 else np.zeros(0, np.int64)
        good = (code[:-2] >= 0) & (code[1:-1] >= 0) & (code[2:] >= 0) & (owner[:-2] == owner[2:]) if len(code) > 2 else np.zeros(0, bool)
        profiles.append(np.bincount(owner[:-2][good] * 64 + word[good], minlength=64 * len(texts)).reshape(-1, 64) if len(code) > 2 else np.zeros((len(texts), 64), np.int64))
        sizes.append(size)
        unclear = unclear + np.bincount(owner[code < 0], minlength=len(texts))
    apart = np.abs(profiles[0] - profiles[1]).sum(axis=1) - 6 * unclear
    return np.maximum(np.abs(sizes[0] - sizes[1]), -(-apart // 6))


def profiles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of A, C, G and T and of their three-letter words, a row for each text."""
    size = np.array([len(t) for t in texts], np.int64)
    code = _BASE[np.frombuffer(b"".join(texts), np.uint8)]
    owner = np.repeat(np.arange(len(texts)), size)
    plain = code >= 0
    letters = np.bincount(owner[plain] * 4 + code[plain], minlength=4 * len(texts)).reshape(-1, 4)
    if len(code) < 3:
        return letters, np.zeros((len(texts), 64), np.int64)
    word = code[:-2] * 16 + code[1:-1] * 4 + code[2:]
    good = plain[:-2] & plain[1:-1] & plain[2:] & (owner[:-2] == owner[2:])
    return letters, np.bincount(owner[:-2][good] * 64 + word[good], minlength=64 * len(texts)).reshape(-1, 64)


def one_to_many(pattern: bytes, texts: list[bytes], limit: int, equal: dict[str, str]) -> np.ndarray:
    """Distances of one text to many; one beyond ``limit`` is given as more than ``limit``.

    Cells further from the diagonal than ``limit`` allows are not worked out: of
    the pattern's words only those pass a letter that a path within ``limit`` can
    reach. The word that enters below begins one up at a letter, and what comes
    from above goes one up with each letter, so values are never too small.
    """
    n = len(pattern)
    size = np.array([len(t) for t in texts], np.int64)
    out = np.where(size == 0, n, size)
    out = np.where(np.abs(size - n) > limit, limit + 1, out)
    own = np.flatnonzero((np.abs(size - n) <= limit) & (size > 0)) if n else np.zeros(0, np.int64)
    own = own[np.argsort(-size[own], kind="stable")]
    words = -(-n // 64)
    if len(own) < max(ALONE, 3 * words):
        # As for few pairs.
        out[own] = [distance(pattern.decode("latin-1"), texts[k].decode("latin-1"), equal) for k in own]
        return np.minimum(out, limit + 1)
    bits = np.zeros((256, words * 64), bool)
    bits[:, :n] = letter_table(equal)[:, np.frombuffer(pattern, np.uint8)]
    match = np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little").view(np.uint64).T)
    ends = np.minimum(np.arange(1, words + 1) * 64, n)
    for low in range(0, len(own), LANES):
        part = own[low : low + LANES]
        text, m = _padded([texts[k] for k in part])
        text = np.ascontiguousarray(text.T)
        most = min(limit, n + int(m[0]))
        above, below = (most + int(m[0]) - n + 1) // 2, (most - int(m[-1]) + n + 1) // 2
        plus, minus = np.full((words, len(part)), ~np.uint64(0)), np.zeros((words, len(part)), np.uint64)
        eq, xv, xh, ph, kept = (np.empty(len(part), np.uint64) for _ in range(5))
        score, last = np.full(len(part), ends[0], np.int64), 0
        # Texts that have ended are at the back.
        for j in range(text.shape[0]):
            k = len(part) if m[-1] > j else int(np.searchsorted(-m, -j, "left"))
            if k < len(part):
                out[part[k:]] = score[k:]
                part, m, score = part[:k], m[:k], score[:k]
                if not k:
                    break
            # What the last row worked out says of the end: rows above are lower by one each at most, and then there is the way to the last letters.
            if j % 32 == 31:
                stay = score - ends[last] + j + n - m <= limit
                if stay.sum() < 0.8 * k:
                    out[part[~stay]] = limit + 1
                    part, m, score, text, plus, minus = part[stay], m[stay], score[stay], np.ascontiguousarray(text[:, :k][:, stay]), plus[:, :k][:, stay], minus[:, :k][:, stay]
                    k = len(part)
                    if not k:
                        break
            if len(eq) > k:
                eq, xv, xh, ph, kept = eq[:k], xv[:k], xh[:k], ph[:k], kept[:k]
            first, reach = max(0, j - above) // 64, min(words - 1, (j + below) // 64)
            while last < reach:
                last += 1
                score += ends[last] - ends[last - 1]
            up, down = _ONE, None
            letters = text[j, :k].astype(np.intp)
            for w in range(min(first, last), last + 1):
                pv, mv = plus[w, :k], minus[w, :k]
                np.take(match[w], letters, out=eq, mode="clip")
                np.bitwise_or(eq, mv, out=xv)
                if down is not None:
                    np.bitwise_or(eq, down, out=eq)
                np.bitwise_and(eq, pv, out=xh)
                np.add(xh, pv, out=xh)
                np.bitwise_xor(xh, pv, out=xh)
                np.bitwise_or(xh, eq, out=xh)
                np.bitwise_or(xh, pv, out=ph)
                np.invert(ph, out=ph)
                np.bitwise_or(ph, mv, out=ph)
                np.bitwise_and(pv, xh, out=xh)
                # What goes out below is the step in the word's last row.
                row = np.uint64((int(ends[w]) - 1) % 64)
                over, under = np.right_shift(ph, row), np.right_shift(xh, row)
                if w == words - 1:
                    over &= _ONE
                    under &= _ONE
                np.left_shift(ph, _ONE, out=ph)
                np.bitwise_or(ph, up, out=ph)
                np.left_shift(xh, _ONE, out=xh)
                if down is not None:
                    np.bitwise_or(xh, down, out=xh)
                np.bitwise_or(xv, ph, out=kept)
                np.invert(kept, out=kept)
                np.bitwise_or(kept, xh, out=pv)
                np.bitwise_and(ph, xv, out=mv)
                up, down = over, under
            score += over.view(np.int64)
            score -= under.view(np.int64)
        out[part] = score
    return np.minimum(out, limit + 1)


def nearest_of(pattern: bytes, texts: list[bytes], counts: tuple[np.ndarray, np.ndarray], k: int, limit: int, near: bool, equal: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """(which, distance): the texts within ``limit`` that may be among the ``k`` nearest. ``counts``: their ``profiles``.

    Lower bounds from letters and lengths drop texts, and those from three-letter
    words where the limit is small against the length; the most promising ones
    come first, the rest up to the distance these reach.
    """
    (letters, words), (own, own_words) = counts, profiles([pattern])
    size = np.array([len(t) for t in texts], np.int64)
    total = letters.sum(axis=1)
    wild = len(pattern) - own.sum() + size - total
    more = np.maximum(letters - own, 0).sum(axis=1)
    low = np.maximum(np.maximum(more, more + own.sum() - total) - wild, np.abs(size - len(pattern)))
    order = np.argsort(low, kind="stable")
    order = order[: np.searchsorted(low[order], limit, "right")]
    first = order[: 0 if near else 2 * k]
    dist = one_to_many(pattern, [texts[i] for i in first], limit, equal)
    if len(first) >= k:
        limit = min(limit, int(np.sort(dist)[k - 1]))
    rest = order[len(first) : np.searchsorted(low[order], limit, "right")]
    if 6 * limit < len(pattern):
        rest = rest[np.abs(words[rest] - own_words).sum(axis=1) - 6 * wild[rest] <= 6 * limit]
    which, dist = np.concatenate([first, rest]), np.concatenate([dist, one_to_many(pattern, [texts[i] for i in rest], limit, equal)])
    return which[dist <= limit], dist[dist <= limit]


def gram_bound(a, b) -> Column:
    """The same for a pair of columns."""

    @arrow_udf(IntegerType())
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        p, q = _encoded(x), _encoded(y)
        got = [gram_bounds(p[k : k + 500], q[k : k + 500]) for k in range(0, len(p), 500)]
        return pa.array(np.concatenate(got or [np.zeros(0, np.int64)]), pa.int32())

    return run(a, b)


def within(a, b, limit, rule: str = "base") -> Column:
    """IUPAC distance of a pair if it is at most ``limit``, else null; pairs beyond it are left early. A null limit is none."""
    equal = equal_letters(rule)

    @arrow_udf(IntegerType())
    def run(x: pa.Array, y: pa.Array, most: pa.Array) -> pa.Array:
        top = np.array([1 << 30 if m is None else m for m in most.to_pylist()], np.int64)
        d = distances(_encoded(x), _encoded(y), equal, limit=top)
        return pa.array(d, pa.int32(), mask=(d > top) | np.asarray(x.is_null()) | np.asarray(y.is_null()))

    return run(a, b, limit)


def divergence(a, b) -> Column:
    """IUPAC distance over the longer length, gaps removed; 0 when either is empty."""
    x, y = (F.upper(F.translate(F.col(c) if isinstance(c, str) else c, "-", "")) for c in (a, b))
    size = F.greatest(F.length(x), F.length(y))
    d = edit_iupac(x, y, "base")["iupac"]
    return F.when((x == "") | (y == ""), F.lit(0.0)).otherwise(d / size)


def locate(pattern: str, text: np.ndarray, size: np.ndarray, equal: dict[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best infix match of one pattern in many texts at once.

    ``text`` is a byte matrix padded with zeros and ``size`` the length of each
    row. Returns distance, start and end (inclusive) of the first best match;
    of all starts with that end the one that spans most is taken.
    """
    dist, end = _scan(pattern, text, size, equal, infix=True, last=False)
    # The start is found by reading the pattern and the text before the end backwards.
    n, width = text.shape
    cols = end[:, None] - np.arange(width)[None, :]
    back = np.where(cols >= 0, np.take_along_axis(text, np.maximum(cols, 0), axis=1), 0)
    _, span = _scan(pattern[::-1], back, end + 1, equal, infix=False, last=True)
    return dist, end - span, end


def _scan(pattern, text, size, equal, infix, last):
    m = len(pattern)
    if not m:
        raise ValueError("patterns hold letters")
    if m > 63:
        return _scan_long(pattern, text, equal, size, infix, last)
    table = np.zeros(256, dtype=np.uint64)
    for ch, bits in match_masks(pattern, equal).items():
        table[ord(ch)] = bits
    n, width = text.shape
    one = np.uint64(1)
    full, top = np.uint64((1 << m) - 1), np.uint64(1 << (m - 1))
    plus = np.full(n, full, dtype=np.uint64)
    minus = np.zeros(n, dtype=np.uint64)
    score = np.full(n, m, dtype=np.int64)
    best, where = score.copy(), np.full(n, -1, dtype=np.int64)
    carry = np.uint64(0 if infix else 1)
    for j in range(width):
        eq = table[text[:, j]]
        xv = eq | minus
        xh = ((((eq & plus) + plus) ^ plus) | eq) & full
        ph = minus | (~(xh | plus) & full)
        mh = plus & xh
        score = score + ((ph & top) != 0) - ((mh & top) != 0)
        ph = ((ph << one) | carry) & full
        mh = (mh << one) & full
        plus = (mh | ~(xv | ph)) & full
        minus = ph & xv
        better = ((score <= best) if last else (score < best)) & (j < size)
        best = np.where(better, score, best)
        where = np.where(better, j, where)
    return best, where


def _scan_long(pattern, text, equal, size, infix, last):
    """The same for patterns longer than a machine word: one column of distances for each text, a letter of all texts at a time."""
    n, width = text.shape
    m = len(pattern)
    differs = np.ones((m, 256), dtype=np.int64)
    for ch, bits in match_masks(pattern, equal).items():
        for i in range(m):
            differs[i, ord(ch)] = 1 - (bits >> i & 1)
    rows = np.arange(m + 1)[:, None]
    column = np.repeat(rows, n, axis=1)
    best, where = column[m].copy(), np.full(n, -1, dtype=np.int64)
    for j in range(width):
        step = np.minimum(column[:-1] + differs[:, text[:, j]], column[1:] + 1)
        start = np.full((1, n), 0 if infix else j + 1)
        column = np.minimum.accumulate(np.concatenate([start, step]) - rows, axis=0) + rows
        score = column[m]
        better = ((score <= best) if last else (score < best)) & (j < size)
        best = np.where(better, score, best)
        where = np.where(better, j, where)
    return best, where
