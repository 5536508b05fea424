"""Byte-level BPE: speculate with the longest match, verify adjacent pairs, merge exactly only where that fails.

Texts are cut into added tokens and words as the tokenizer file says. New words of a batch are tokenised greedily, always taking the longest token
of the vocabulary. Such a proposal is the exact result if every token is what its own bytes merge to and every two neighbours are compatible, that
is, if merging their joint bytes never joins across the seam. The pairs of all proposals are tested together, as arrays over the ranks of merges;
only words with a failing pair go through exact merging.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import pieces

#: The word pattern of byte-level BPE (a fixed value of the public tokenizer).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks of text in each of the two generations that a worker remembers: when the younger one is full the older one is forgotten, which changes nothing
#: but time.
REMEMBERED = 120_000
#: Bytes of text that are cut into words at once.
PIECE = 1 << 20
#: Words up to this many bytes are merged together as arrays, longer ones by a heap.
SHORT = 24
_NONE = -1
_NEVER = 1 << 30
#: Where a space between two white-space characters stands, words don't end before each space.
_CROWDED = regex.compile(r"\s \s")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, and its byte: printable Latin letters stand for themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class Table:
    """Numbers by number: a hash table with open addresses, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        keys, first = np.unique(keys, return_index=True)
        self.bits, self.missing = max(4, int(4 * len(keys)).bit_length()), missing
        self.keys = np.full(1 << self.bits, _NONE)
        self.values = np.full(len(self.keys), missing, np.int32)
        todo, at = np.arange(len(keys)), self._place(keys)
        while len(todo):
            free = self.keys[at] == _NONE
            _, once = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[once]
            self.keys[at[put]], self.values[at[put]] = keys[todo[put]], values[first[todo[put]]]
            left = np.ones(len(todo), bool)
            left[put] = False
            todo, at = todo[left], (at[left] + 1) & (len(self.keys) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], self.missing)
        todo = np.flatnonzero((held != keys) & (held != _NONE))
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self.keys) - 1)
            held = self.keys[at]
            same = held == keys[todo]
            out[todo[same]] = self.values[at[same]]
            more = ~same & (held != _NONE)
            todo, at = todo[more], at[more]
        return out


class Bpe:
    """A byte-level BPE tokenizer from a tokenizer file; without normaliser, prefix space or dropout."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE is read")
        letters = byte_letters()
        raw = {token: bytes(letters[c] for c in token) for token in model["vocab"]}
        self.ids = {raw[token]: i for token, i in model["vocab"].items()}
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.bytes = token_bytes(text)
        self.pattern = regex.compile(WORDS)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

        # A token's own merge tells its halves and rank; merges are found by pair.
        n = len(self.bytes)
        self.left, self.right, self.when = np.full(n, _NONE), np.full(n, _NONE), np.full(n, _NONE)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = np.array([(model["vocab"][a], model["vocab"][b]) for a, b in merges], np.int64).reshape(-1, 2)
        self.made = np.array([self.ids[raw[a] + raw[b]] for a, b in merges], np.int64)
        ranks = np.arange(len(pairs))[::-1]
        self.left[self.made[::-1]], self.right[self.made[::-1]], self.when[self.made[::-1]] = pairs[::-1, 0], pairs[::-1, 1], ranks
        self.merges = Table(pairs[:, 0] << 32 | pairs[:, 1], np.arange(len(pairs)), _NEVER)
        self.byte_ids = np.array([self.ids[bytes([k])] for k in range(256)])
        #: Tokens that their own bytes do not merge to can't be proposed.
        tokens = [t for t in self.ids if len(t) == 1 or self.when[self.ids[t]] != _NONE]
        sound = [t for t, got in zip(tokens, self.merge(tokens)) if got == [self.ids[t]]]
        # The trie of sound tokens: the next node by node and byte, the token that ends at each node.
        nodes: dict[bytes, int] = {b"": 0}
        ends = [_NONE]
        links: list[tuple[int, int, int]] = []
        for t in sorted(sound):
            for k in range(1, len(t) + 1):
                if t[:k] not in nodes:
                    nodes[t[:k]] = len(ends)
                    links.append((nodes[t[: k - 1]], t[k - 1], len(ends)))
                    ends.append(_NONE)
            ends[nodes[t]] = self.ids[t]
        self.ends = np.array(ends, np.int32)
        f, c, to = np.array(links, np.int64).T
        self.next = Table(f << 8 | c, to, _NONE)
        #: Ids, as the bytes of 32-bit integers, of text from a space to before the next one; and of texts' beginnings.
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.heads: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge."""
        return self.merges.get(a.astype(np.int64) << 32 | b)

    # -- exact merging

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The lowest-ranked pair is joined, the leftmost first, until no pair has a rank; short words of about one length together."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        for low, high in ((0, 8), (8, 12), (12, 16), (16, SHORT)):
            own = np.flatnonzero((sizes > low) & (sizes <= high))
            if not len(own):
                continue
            size = sizes[own]
            flat = np.frombuffer(b"".join([words[k].ljust(high, b"\0") for k in own]), np.uint8).reshape(-1, high)
            ids = np.where(np.arange(high) < size[:, None], self.byte_ids[flat], _NONE)
            rank = np.where(np.arange(1, high) < size[:, None], self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, high - 1), _NEVER)
            live = np.arange(len(own))
            columns = np.arange(high)
            while len(live):
                j = rank[live].argmin(axis=1)
                best = rank[live, j]
                live, j, best = (v[best < _NEVER] for v in (live, j, best))
                if not len(live):
                    break
                # Row by row: the joined token at j, all after it one to the left.
                moved = np.minimum(columns + (columns > j[:, None]), high - 1)
                rows = np.take_along_axis(ids[live], moved, 1)
                rows[:, -1] = _NONE
                rows[np.arange(len(live)), j] = self.made[best]
                ids[live] = rows
                kept = np.take_along_axis(rank[live], np.minimum(moved[:, :-1], high - 2), 1)
                kept[:, -1] = _NEVER
                for at in (j - 1, j):
                    ok = np.flatnonzero((at >= 0) & (at < high - 1))
                    a, b = rows[ok, at[ok]], rows[ok, np.minimum(at[ok] + 1, high - 1)]
                    kept[ok, at[ok]] = np.where((a != _NONE) & (b != _NONE), self.ranks(np.maximum(a, 0), np.maximum(b, 0)), _NEVER)
                rank[live] = kept
            for k, row, n in zip(own.tolist(), ids.tolist(), (ids != _NONE).sum(axis=1).tolist()):
                out[k] = row[:n]
        for k in np.flatnonzero(sizes > SHORT).tolist():
            out[k] = self.merge_long(words[k])
        return out

    def merge_long(self, word: bytes) -> list[int]:
        """The same with a heap and links, for words of any length."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        if n < 2:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        start = self.ranks(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, k, ids[k], ids[k + 1]) for k, r in enumerate(start) if r < _NEVER]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            j = after[k] if ids[k] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = int(self.made[rank]), _NONE
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (r := self.rank(ids[x], ids[y])) < _NEVER:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [i for i in ids if i != _NONE]

    def rank(self, a: int, b: int) -> int:
        return int(self.ranks(np.array([a]), np.array([b]))[0])

    # -- speculation

    def greedy(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) of the longest-match proposals, in order: all words walk down the trie at once, byte by byte."""
        words, tokens, orders = [], [], []
        live, begin = np.arange(len(starts)), starts.copy()
        at, node = starts.copy(), np.zeros(len(starts), np.int64)
        best, best_end = np.full(len(starts), _NONE), starts.copy()
        while len(live):
            inside = at[live] < ends[live]
            to = np.where(inside, self.next.get(node[live] << 8 | data[np.minimum(at[live], len(data) - 1)]), _NONE)
            on = live[to != _NONE]
            node[on] = to[to != _NONE]
            at[on] += 1
            token = self.ends[node[on]]
            got = on[token != _NONE]
            best[got], best_end[got] = token[token != _NONE], at[got]
            stuck = live[to == _NONE]
            words.append(stuck)
            tokens.append(best[stuck])
            orders.append(begin[stuck].copy())
            at[stuck] = begin[stuck] = best_end[stuck]
            node[stuck] = 0
            live = live[begin[live] < ends[live]]
        word, token, order = np.concatenate(words), np.concatenate(tokens), np.concatenate(orders)
        sort = np.argsort(order, kind="stable")
        return word[sort], token[sort]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of a then b merge to just (a, b), for arrays of sound tokens.

        Undo the merges of both sides from the last to the first. The parts at
        the seam just before a merge of rank r are a rightmost part of a and a
        leftmost part of b; had they a rank below r (or r itself, on the right
        side: of equal pairs the left one goes first), they would be joined then.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), _NEVER)
        x, y = a.astype(np.int64), b.astype(np.int64)
        while len(live):
            joins = self.ranks(x[live], y[live]) < limit[live]
            ok[live[joins]] = False
            live = live[~joins]
            wx, wy = self.when[x[live]], self.when[y[live]]
            live, wx, wy = (v[(wx != _NONE) | (wy != _NONE)] for v in (live, wx, wy))
            one, two = live[wx > wy], live[wx <= wy]
            limit[one], x[one] = wx[wx > wy], self.right[x[one]]
            limit[two], y[two] = wy[wx <= wy] + 1, self.left[y[two]]
        return ok

    def tokenize(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of all words, none of them empty, in order, and where each word's ids begin (one more at the end)."""
        ends = np.cumsum([len(w) for w in words])
        starts = np.concatenate([[0], ends[:-1]])
        word, token = self.greedy(np.frombuffer(b"".join(words), np.uint8), starts, ends)
        inner = np.flatnonzero(word[1:] == word[:-1])
        keys, back = np.unique(token[inner].astype(np.int64) << 32 | token[inner + 1], return_inverse=True)
        good = self.compatible(keys >> 32, keys & 0xFFFFFFFF)
        failed = np.unique(word[inner[~good[back]]])
        if not len(failed):
            return token.astype(np.int32), np.searchsorted(word, np.arange(len(words) + 1))
        merged = self.merge([words[k] for k in failed.tolist()])
        size = np.bincount(word, minlength=len(words))
        size[failed] = [len(ids) for ids in merged]
        first = np.concatenate([[0], np.cumsum(size)])
        again = np.zeros(len(words), bool)
        again[failed] = True
        out = np.empty(first[-1], np.int32)
        out[np.repeat(~again, size)] = token[~again[word]]
        out[np.repeat(again, size)] = np.fromiter(chain.from_iterable(merged), np.int32)
        return out, first

    # -- texts

    def parts(self, text: str) -> list[str | int]:
        """Words, and the ids of added tokens, in order."""
        if self.split is None or not self.split.search(text):
            return self.pattern.findall(text)
        out, k = [], 0
        for m in self.split.finditer(text):
            out += self.pattern.findall(text[k : m.start()])
            out.append(self.added[m.group()])
            k = m.end()
        return out + self.pattern.findall(text[k:])

    def learn(self, chunks: list[str], put: str = "") -> list[bytes]:
        """The ids of each chunk after ``put`` as the bytes of 32-bit integers.

        After a space, chunks with no white space at either end are cut side by
        side: a word ends before the space of the next one. Others are cut one
        by one.
        """
        joint = [put and c and not c[0].isspace() and not c[-1].isspace() for c in chunks]
        side = [c for c, j in zip(chunks, joint) if j]
        cut = self.pattern.findall("".join([put + c for c in side]))
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        counts = np.diff(np.searchsorted(ends, np.cumsum([len(c) + len(put) for c in side]), "right"), prepend=0).tolist()
        own = [self.parts(put + c) for c, j in zip(chunks, joint) if not j]
        counts += map(len, own)
        cut += chain.from_iterable(own)
        words = [w for w in dict.fromkeys(cut) if isinstance(w, str)]
        ids, first = self.tokenize([w.encode() for w in words]) if words else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        # Added tokens stand behind the words as words of one id.
        extra = [w for w in dict.fromkeys(cut) if not isinstance(w, str)]
        ids, first = np.append(ids, np.array(extra, np.int32)), np.append(first, first[-1] + 1 + np.arange(len(extra)))
        place = {w: k for k, w in enumerate([*words, *extra])}
        which = np.fromiter(map(place.__getitem__, cut), np.int64, len(cut))
        size = first[which + 1] - first[which]
        till = np.concatenate([[0], np.cumsum(size)])
        raw = ids[np.arange(till[-1]) + np.repeat(first[which] - till[:-1], size)].tobytes()
        bounds = (4 * till[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]).tolist()
        made = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        together, alone = iter(made[: len(side)]), iter(made[len(side) :])
        return [next(together) if j else next(alone) for j in joint]

    def _remember(self, young: dict[str, bytes], old: dict[str, bytes], chunks: set[str], put: str) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """Both generations of known chunks, with all of ``chunks`` in the younger one."""
        new = chunks.difference(young)
        if len(young) + len(new) > REMEMBERED:
            young, old, new = {}, young, chunks
        found = new.intersection(old)
        young.update((c, old[c]) for c in found)
        unknown = list(new.difference(found))
        young.update(zip(unknown, self.learn(unknown, put)))
        return young, old

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as the bytes of 32-bit integers; a null is an empty text.

        A word ends before every space but where three white-space characters
        with a space in the middle stand, so the stretches between spaces are
        looked up; a text with such a place is cut as a whole.
        """
        texts = [t or "" for t in texts]
        whole = {t for t in texts if _CROWDED.search(t) or self.split and self.split.search(t)}
        cut = [[] if t in whole else t.split(" ") for t in texts]
        self.heads = self._remember(*self.heads, {c[0] for c in cut if c}, "")
        self.known = self._remember(*self.known, set(chain.from_iterable([c[1:] for c in cut])), " ")
        alone = list(whole)
        own = dict(zip(alone, self.learn(alone)))
        known, heads = self.known[0].__getitem__, self.heads[0]
        return [b"".join([heads[c[0]], *map(known, c[1:])]) if c else own[t] for t, c in zip(texts, cut)]

    def decode(self, ids: np.ndarray) -> str:
        return joined(self.bytes, ids)


def joined(table: list[bytes], ids: np.ndarray) -> str:
    """The text of ids; bytes that are no UTF-8 become replacement characters."""
    return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(1)
def tokenizer(spec: str) -> Bpe:
    return Bpe(spec)


@lru_cache(1)
def token_bytes(spec: str) -> list[bytes]:
    """The bytes of each id."""
    read = json.loads(spec)
    letters = byte_letters()
    ids = {i: bytes(letters[c] for c in token) for token, i in read["model"]["vocab"].items()} | {a["id"]: a["content"].encode() for a in read.get("added_tokens", [])}
    return [ids.get(i, b"") for i in range(1 + max(ids))]


def _shared(df: DataFrame, path: str):
    """The file's text: one vocabulary, of a fixed size."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """The columns ``keep`` (by default all) with ``ids`` (array of int) of the whole text and, if a name is given, the text decoded from them.

    ``path`` is a tokenizer file the driver can read. Null and empty texts have no ids; repeated rows each get theirs; columns with the names of the
    results are replaced.
    """
    made = ["ids", *([decoded] if decoded else [])]
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in made]
    spec = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(spec.value)
        for batch in batches:
            for piece in pieces(batch, "_text", PIECE):
                ids = bpe.encode(piece.column("_text").to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
                out = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))]
                if decoded:
                    out.append(pa.array([bpe.decode(np.frombuffer(i, np.int32)) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), *out], [*keep, *made])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    kinds = [T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    return rows.mapInArrow(run, T.StructType([rows.schema[c] for c in keep] + kinds))


def decode(rows: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids in the column ``to`` (null ids: null)."""
    spec = _shared(rows, path)
    keep = [c for c in rows.columns if c != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(spec.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                piece = batch.slice(low, 500)
                column = piece.column(ids)
                flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
                null = column.is_null().to_pylist()
                made = pa.array([None if null[k] else joined(table, flat[at[k] : at[k + 1]]) for k in range(len(column))], pa.string())
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), made], [*keep, to])

    return rows.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, T.StructType([rows.schema[c] for c in keep] + [T.StructField(to, T.StringType())]))
