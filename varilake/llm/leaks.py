"""Passages of test items inside a corpus, by pigeonhole edit matching.

A passage is a window of `window` words of an item, taken at every word. With an error budget of e word edits, a
passage cut into e + 1 parts leaves one part without an error, so that part stands in the document word for word. The
items are therefore cut into pieces short enough for every passage to hold e + 1 whole ones; an automaton finds all
exact piece hits in one pass over each document; and the surroundings of each hit are verified with Myers' bit-parallel
edit distance over words.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varilake.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 12
"""Words that a document and an item must have in common."""
BLOCK_CHARS = 8_000_000
"""Characters of items that one automaton holds; of more, the pieces are hashed."""
HASHED_PIECES = 16_000_000
"""Hashed pieces, of eight bytes each, that are sent to the tasks at a time; more take more passes over the documents."""
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def normalized(text: str) -> str:
    """Its words (runs of ASCII letters and digits) in lower case, each with a blank before it, and one at the end."""
    words = text.encode("utf-8", "replace").translate(_WORDS).split()
    return f" {b' '.join(words).decode('ascii')} " if words else " "


def piece_words(window: int, edits: int) -> int:
    """The longest piece of which every passage holds edits + 1 whole ones, wherever it begins."""
    return max(1, (window + 1) // (edits + 2))


def myers(pattern: list[str], text: list[str]) -> int:
    """Least number of word edits between the pattern and any run of words in text (Myers 1999, over words)."""
    at: dict[str, int] = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << i
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = full, 0, m
    best = score
    for w in text:
        eq = at.get(w, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp = vn | ~(d0 | vp) & full
        hn = vp & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = hp << 1, hn << 1  # a match may begin anywhere: no 1 is shifted in
        vp = (hn | ~(d0 | hp)) & full
        vn = hp & d0 & full
        best = min(best, score)
    return best


class Searcher:
    """The automaton of one block of items."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, edits: int = 0) -> None:
        self.window, self.edits, self.piece = window, edits, piece_words(window, edits)
        # an id may stand for several texts: each is searched for by its place, and answered by its id
        self.ids, self.words = [i for i, _ in items], [normalized(t).split() for _, t in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, words in enumerate(self.words):
            for at in range(0, len(words) - self.piece + 1, self.piece) if len(words) >= window else ():
                places.setdefault(f" {' '.join(words[at : at + self.piece])} ", []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def search(self, text: str) -> dict[int, int]:
        """Item -> the fewest word edits of any of its passages in the text, where that is within the budget."""
        found: dict[int, int] = {}
        if self.empty:
            return found
        body, reach = normalized(text), self.window - self.piece + self.edits
        for end, (length, where) in self.automaton.iter(body):
            start = end - length + 1
            around = _last_words(body, start, reach) + body[start:end].split() + _next_words(body, end, reach)
            there = set(around)
            for item, at in where:
                key = self.ids[item]
                if found.get(key, 1) and (best := self.verify(around, there, item, at)) is not None:
                    found[key] = min(best, found.get(key, best))
        return found

    def verify(self, around: list[str], there: set[str], item: int, at: int) -> int | None:
        """Least edits over the passages that hold the piece at word `at`, against the hit's surroundings."""
        words, best = self.words[item], None
        for first in range(max(0, at + self.piece - self.window), min(at, len(words) - self.window) + 1):
            passage = words[first : first + self.window]
            # each word that stands nowhere near costs an edit
            if sum(w not in there for w in passage) <= self.edits and (d := myers(passage, around)) <= self.edits and (best is None or d < best):
                best = d
                if not d:
                    break
        return best


def _last_words(body: str, start: int, n: int) -> list[str]:
    """The n words before a place that is a blank."""
    at = start
    for _ in range(n):
        if at <= 0:
            break
        at = body.rfind(" ", 0, at)
    return body[max(at, 0) : start].split()


def _next_words(body: str, end: int, n: int) -> list[str]:
    at = end
    for _ in range(n):
        if (nxt := body.find(" ", at + 1)) < 0:
            break
        at = nxt
    return body[end:at].split()


class Powers:
    """Powers of the base of the hash and of its inverse modulo 2^64, as far as texts have needed them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (_BASE, _INVERSE))

    def pieces(self, body: str, piece: int) -> np.ndarray:
        """A hash for every run of `piece` words of a normalized text, with the blanks around it, by its first word.

        The letters times the powers of the base are added up once; a run's sum times the inverse of its first power does
        not depend on where the run stands.
        """
        letters = np.frombuffer(body.encode("ascii"), np.uint8)
        blanks = np.flatnonzero(letters == 32)
        if len(blanks) <= piece:
            return np.zeros(0, np.uint64)
        self.upto(len(letters))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * self.up[: len(letters)], dtype=np.uint64)])
            first, last = blanks[:-piece], blanks[piece:]
            return (sums[last + 1] - sums[first]) * self.down[first]


def _hashed_pieces(items: DataFrame, key: str, text: str, window: int, edits: int) -> DataFrame:
    """(h, item, context, off): every piece of every item, the words of its passages, and where in them it begins."""
    piece = piece_words(window, edits)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            rows = []
            for item, t in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                body = normalized(t)
                words = body.split()
                if len(words) < window:
                    continue
                hashes = powers.pieces(body, piece).view(np.int64)
                for at in range(0, len(words) - piece + 1, piece):
                    low = max(0, at + piece - window)
                    rows.append((int(hashes[at]), item, " ".join(words[low : at + window]), at - low))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int32()))], names=["h", "item", "context", "off"])

    return items.select(F.col(key).cast("bigint"), text).mapInArrow(cut, "h BIGINT, item BIGINT, context STRING, off INT")


def _hashed_leaks(rows: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str, window: int, edits: int) -> DataFrame:
    """leaks for many items: documents' runs of words are looked up among the hashes of all pieces in one pass; only hits are
    shuffled, to meet the items that hold the piece, and verified."""
    piece, kind = piece_words(window, edits), rows.schema[doc_key].dataType.simpleString()
    reach = window - piece + edits
    pieces = materialize(_hashed_pieces(items, item_key, text, window, edits))
    hashes = pieces.select("h").distinct()
    passes = max(1, math.ceil(hashes.count() / HASHED_PIECES))
    hits = None
    for k in range(passes):
        part = hashes.where(F.pmod(F.xxhash64("h"), F.lit(passes)) == k).toArrow()["h"].to_numpy().view(np.uint64)
        sent = rows.sparkSession.sparkContext.broadcast(np.sort(part))

        def look(batches: Iterable[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            powers, known = Powers(), sent.value
            for batch in batches:
                out = []
                for i, t in enumerate(batch[1].to_pylist()):
                    body = normalized(t)
                    found = powers.pieces(body, piece)
                    at = np.searchsorted(known, found)
                    at[at == len(known)] = 0
                    places = np.flatnonzero(known[at] == found) if len(known) else np.zeros(0, np.int64)
                    if len(places):
                        words = body.split()
                        near = {(int(h), " ".join(words[max(0, p - reach) : p + piece + reach])) for p, h in zip(places.tolist(), found[places].view(np.int64), strict=True)}
                        out += [(i, h, around) for h, around in sorted(near)]
                yield pa.RecordBatch.from_arrays([batch[0].take(pa.array([r[0] for r in out], pa.int64())), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], names=["doc", "h", "around"])

        found = rows.mapInArrow(look, f"doc {kind}, h BIGINT, around STRING")
        hits = found if hits is None else hits.unionByName(found)

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, ids, best = [], [], []
            for i, (item, around, context, off) in enumerate(zip(*(batch[j].to_pylist() for j in range(1, 5)), strict=True)):
                near, words = around.split(), context.split()
                d = min((myers(words[a : a + window], near) for a in range(min(off, len(words) - window) + 1)), default=window)
                if d <= edits:
                    docs.append(i)
                    ids.append(item)
                    best.append(d)
            yield pa.RecordBatch.from_arrays([batch[0].take(pa.array(docs, pa.int64())), pa.array(ids, pa.int64()), pa.array(best, pa.int32())], names=["doc", "item", "edits"])

    pairs = hits.join(pieces, "h").select("doc", "item", "around", "context", "off").mapInArrow(check, f"doc {kind}, item BIGINT, edits INT")
    return pairs.select(F.col("doc").alias(doc_key), F.col("item").alias(item_key), "edits")


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", window: int = WINDOW, edits: int = 0, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_key, item_key, edits): documents that hold a passage of an item within the budget of word edits.

    The items are a stated query set. Up to block_chars characters of them are sent to all tasks as one automaton.
    Of more, the hashes of their pieces are sent, and only the surroundings of hits are shuffled. Either way
    the documents are read once (more than HASHED_PIECES pieces: once for each so many), and what a task holds is
    bounded whatever the number of items. Words are runs of ASCII letters and digits, case and all between them
    ignored. Items of fewer than `window` words have no passage. Null texts hold nothing; equal texts under different
    keys are each reported, a pair of keys once; texts are searched whole. Item keys are integers; an item
    key that repeats stands for all of its texts. Empty tables give no row.
    """
    kind, item_kind = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    rows = docs.select(doc_key, text).where(F.col(text).isNotNull())
    given = items.select(item_key, text).where(F.col(text).isNotNull() & F.col(item_key).isNotNull())
    if (given.agg(F.sum(F.length(text))).first()[0] or 0) > block_chars:
        found = _hashed_leaks(rows, given, doc_key, item_key, text, window, edits)
    else:
        block = [(r[0], r[1]) for r in given.orderBy(item_key).collect()]  # of at most block_chars characters

        def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(block, window, edits)
            for batch in batches:
                hits = [(d, i, e) for d, t in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True) for i, e in searcher.search(t).items()]
                doc, item, edit = ([h[c] for h in hits] for c in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(doc, batch[0].type), pa.array(item, pa.int64()), pa.array(edit, pa.int32())], names=[doc_key, item_key, "edits"])

        found = rows.mapInArrow(search, f"{doc_key} {kind}, {item_key} BIGINT, edits INT")
    # several hits of one document and item are one pair; only hits are shuffled
    pairs = found.groupBy(doc_key, item_key).agg(F.min("edits").alias("edits"))
    return pairs.withColumn(item_key, F.col(item_key).cast(item_kind))
