"""Personal information in free text, by a skip-chain conditional random field.

A text is cut into words, number groups, mail addresses and signs; each is labelled name, address, phone, id_number,
email or nothing. A linear chain scores a token by itself, by its three neighbours on either side and by the step from
label to label. Skip edges join tokens of a text, however far apart, that are likely to be the same thing:

    same     the same capitalised word (case and accents ignored)
    similar  capitalised words that share a hyphen part or differ in one letter
    initial  an initial and a given name that begins with it, before or after the same surname
    number   the same long number however it is punctuated, or the same short one beside the same word

An edge favours equal labels by a weight for its kind and label. Loopy message passing between chain and skip edges makes
a person found in a clear context be found elsewhere. The messages of a group's tokens are added up once and each token
takes out its own, which is the same as passing them along all pairs of tokens, in linear time; edges of a group of n
tokens weigh 1 / sqrt(n - 1).

Tokens whose own score is far below that of "nothing" are taken for nothing (PRUNE). They cut a text into short runs,
which are independent given these, so only the runs are inferred, all of about equal length at once.

Chain and skip weights are trained together by pii_train and kept in pii_model.json.
"""

from __future__ import annotations

import gc
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LABELS = ("", "name", "address", "phone", "id_number", "email")
LINKS = ("same", "similar", "initial", "number")
REACH = 3
ROUNDS = 2
"""Rounds of messages along the skip edges."""
PRUNE = 8.0
"""A token whose best label scores so much less than nothing, steps and skip edges aside, is nothing."""
MISS_COST = 2.0
"""A token is labelled if nothing is less than so many times as likely as its best label: what is missed costs more than what is masked in vain."""
LONG_NUMBER = 5
"""Digits from which a number is linked by itself."""
CHUNK_CHARS = 2_000_000
"""Characters of text that a task labels at a time (and at least one text)."""
MODEL = Path(__file__).with_name("pii_model.json")

_WS = r"(?:[^\S\n]++\n?[^\S\n]*+|\n[^\S\n]*+)"
_CLOSED = "(?:" + "|".join(rf"(?<=\(\d{{{n}}})" for n in range(1, 6)) + r")\)"
_NUMBER = rf"(?:[A-Z]{{1,2}}(?=\d)|\+\s?(?=\d)|\((?=\d))?\d++(?:(?:{_WS}|[-/.]|{_CLOSED}{_WS}?|{_WS}?\()\d++)*+(?:[A-Za-z]\b|(?<=\d\d\s\d\d\s\d\d\d)\s[A-Z]\b(?!['’])| [A-Z](?![\w.'’])|{_WS}bis\b)?"
_WORD = r"[^\W\d_]+(?:['’](?!s\b)[^\W\d_]+|-[^\W\d_]+)*"
_TOKEN = re.compile(rf"(?:[a-zà-ÿ]++(?!['’-])|(?=[\dA-Z+(]){_NUMBER}|{_WORD}|\S)\s*+")
_AT = re.compile(r"@|[\[({]\s?at\s?[\])}]", re.IGNORECASE)
_AT_WORD = re.compile(r"\bat\s++(?=[\w-]++\s++dot\s)", re.IGNORECASE)
_HOST = re.compile(r"\s?[\w-]++(?:(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\s++dot\s++)[\w-]++)++\s*+", re.IGNORECASE)
_PARAGRAPH = re.compile(r"\n[^\S\n]*+\n\s*+(?=\S)")
_WRITTEN_OUT = re.compile(r"at\s?[\])}]| dot ", re.IGNORECASE)
MAIL = "@mail"
_NO_DIGIT = re.compile(r"\D+")
_NINES = str.maketrans("0123456789", "9999999999")


def mails_of(text: str) -> list[tuple[int, int]]:
    """Where mail addresses stand, also such as are written out (name [at] host [dot] tld), with the space after them."""
    out = []
    for at in [_AT, _AT_WORD][: 2 if " dot " in text or " DOT " in text else 1]:
        for m in at.finditer(text):
            start = end = m.start() - (text[m.start() - 1 : m.start()].isspace())
            while start > 0 and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
                start -= 1
            if start < end and (host := _HOST.match(text, m.end())):
                out.append((start, host.end()))
    return sorted(out)


def tokens_of(text: str) -> list[str]:
    """Every token with the white space after it, and an empty one after each paragraph, which no entity crosses.

    What stands before the first token is not part of any.
    """
    cut = _with_mails if "@" in text or _WRITTEN_OUT.search(text) else _TOKEN.findall
    out, at = [], 0
    for m in _PARAGRAPH.finditer(text):
        out += cut(text[at : m.end()])
        out.append("")
        at = m.end()
    return out + cut(text[at:])


def _with_mails(text: str) -> list[str]:
    if "@" not in text and "at" not in text and "AT" not in text:
        return _TOKEN.findall(text)
    out, upto = [], 0
    for a, b in mails_of(text):
        if a >= upto:
            out += _TOKEN.findall(text[upto:a])
            out.append(text[a:b])
            upto = b
    return out + _TOKEN.findall(text[upto:])


def canonical(token: str) -> str:
    """The kind of token that all features depend on: digits become 9, a mail address is only that it is one."""
    core = token.rstrip()
    gap = token[len(core) :]
    ws = "" if not gap else " " if "\n" not in gap else "\n" if gap.count("\n") == 1 else "\n\n"
    if len(core) > 4 and ("@" in core or core[0].isalnum() and ("[" in core or "(" in core or "{" in core or " " in core) and (_AT.search(core) or _AT_WORD.search(core))):
        return MAIL + ws
    if any(c.isdigit() for c in core):
        return re.sub(r"\s+", " ", core.translate(_NINES)) + ws
    return core + ws


def shape(word: str) -> str:
    if word.islower():
        return "x"
    if word.isupper():
        return "X" if len(word) == 1 else "XX"
    parts = word.split("-")
    if all(p[:1].isupper() and (p[1:].islower() or len(p) == 1) for p in parts):
        return "Xx" if len(parts) == 1 else "Xx-Xx"
    return "mix"


def fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def features(kind: str) -> list[str]:
    """The features of a canonical token; each has a weight for every label and offset."""
    core = kind.rstrip()
    gap = kind[len(core) :]
    out = [f"ws={len(gap) if gap != chr(10) else 9}"]
    if core == MAIL:
        return [*out, "mail"]
    if any(c.isdigit() for c in core):
        digits = core.count("9")
        return [*out, "num", f"num={core}", f"digits={min(digits, 12)}", f"first={core[0] if not core[0].isalpha() else 'A'}", f"last={'9' if core[-1] == '9' else 'a' if core[-1].islower() else 'A'}",
                f"seps={''.join(sorted(set(re.sub('[9A-Za-z]', '', core))))}", f"groups={min(len(re.findall('9+', core)), 6)}", f"lead={len(re.match('[^9]*(9*)', core)[1])}"]
    if not core[0].isalpha():
        return [*out, f"sign={core}", f"sign={core}{len(gap)}"]
    low = core.lower()
    out += [f"w={low}", f"shape={shape(core)}"]
    if shape(core) != "x":
        out += [f"cap3={fold(core)[-3:]}", f"cap4={fold(core)[-4:]}", f"pre3={fold(core)[:3]}", f"len={min(len(core), 9)}"]
    else:
        out += [f"suf3={low[-3:]}"]
    return out


def forward_backward(e: np.ndarray, step: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Marginals of runs of equal length between nothing and nothing. e: (runs, length, labels), exponentials of scores.

    Also the logarithm of each run's sum over labellings, and the expected number of steps between labels.
    """
    n, length, k = e.shape
    alpha, scale = np.empty_like(e), np.empty((n, length), e.dtype)
    a = step[0] * e[:, 0]
    for t in range(length):
        if t:
            a = (alpha[:, t - 1] @ step) * e[:, t]
        scale[:, t] = a.sum(axis=1)
        alpha[:, t] = a / scale[:, t, None]
    last = alpha[:, -1] @ step[:, 0]
    beta = np.empty_like(e)
    beta[:, -1] = step[:, 0]
    for t in range(length - 2, -1, -1):
        b = (beta[:, t + 1] * e[:, t + 1]) @ step.T
        beta[:, t] = b / b.max(axis=1, keepdims=True)
    p = alpha * beta
    p /= p.sum(axis=2, keepdims=True)
    expected = None
    if pairs:
        expected = np.zeros_like(step)
        expected[0] += p[:, 0].sum(axis=0)
        expected[:, 0] += p[:, -1].sum(axis=0)
        for t in range(1, length):
            right = beta[:, t] * e[:, t]
            z = np.einsum("ni,ij,nj->n", alpha[:, t - 1], step, right)
            expected += step * ((alpha[:, t - 1] / z[:, None]).T @ right)
    return p, np.log(scale).sum(axis=1) + np.log(last), expected


@dataclass
class Edges:
    """Memberships of tokens in groups of linked tokens: token, group (numbered from 0), kind of edge, and each group's size."""

    token: np.ndarray
    group: np.ndarray
    kind: np.ndarray
    size: np.ndarray

    def scale(self) -> np.ndarray:
        """The weight of the edges of each membership's group."""
        return 1 / np.sqrt(self.size[self.group] - 1)


def grouped(keys: list[tuple[int, np.ndarray, np.ndarray]]) -> Edges:
    """Edges from (kind, tokens, a key for each): groups of two or more tokens with the same key."""
    token, group, kind, size = [], [], [], []
    at = 0
    for k, tokens, key in keys:
        if not len(tokens):
            continue
        _, g, n = np.unique(key, return_inverse=True, return_counts=True)
        kept = np.flatnonzero(n > 1)
        number = np.full(len(n), -1)
        number[kept] = np.arange(len(kept)) + at
        inside = number[g] >= 0
        token.append(tokens[inside])
        group.append(number[g][inside])
        kind.append(np.full(inside.sum(), k))
        size.append(n[kept])
        at += len(kept)
    join = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    return Edges(join(token), join(group), join(kind), join(size))


def spellings(word: str) -> list[str]:
    """What similar words share: the word, each without one of its letters if there are five or more, its hyphen parts."""
    parts = word.split("-")
    out = [word, *(p for p in parts if len(p) > 2)] if len(parts) > 1 else [word]
    return out + [word[:i] + word[i + 1 :] for i in range(len(word))] if len(word) > 4 else out


class Tagger:
    """The trained field, with the scores of all kinds of tokens met so far."""

    def __init__(self, model: dict) -> None:
        self.k = len(LABELS)
        self.weights = {f: np.asarray(w, np.float32).reshape(2 * REACH + 1, self.k) for f, w in model["weights"].items()}
        self.step = np.exp(np.asarray(model["step"], np.float32))
        self.skip = np.asarray(model["skip"], np.float64)
        self.clear()

    def clear(self) -> None:
        # kind 0 is what stands beyond the ends of a text
        self.kinds: dict[str, int] = {"": 0}
        self.raw: dict[str, int] = {}
        self.words: dict[str, int] = {}
        # spellings of word i: shared[shared_ends[i - 1]:shared_ends[i]]
        self.shared, self.shared_ends = array("q"), array("q", [0])
        self.keys: dict[str, int] = {}
        self.scores = np.zeros((1024, 2 * REACH + 1, self.k), np.float32)
        self.word, self.letter = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.single, self.number, self.sign = np.zeros(1024, bool), np.zeros(1024, bool), np.zeros(1024, np.int64)
        self._score(0, ["edge"])

    def _score(self, i: int, names: list[str]) -> None:
        for f in names:
            if (w := self.weights.get(f)) is not None:
                self.scores[i] += w

    def _word(self, folded: str) -> int:
        if (i := self.words.get(folded)) is None:
            i = self.words[folded] = len(self.words) + 1
            self.shared.extend(self.keys.setdefault(k, len(self.keys)) for k in dict.fromkeys(spellings(folded)))
            self.shared_ends.append(len(self.shared))
        return i

    def kind_of(self, token: str) -> int:
        kind = canonical(token)
        i = self.kinds.get(kind)
        if i is None:
            i = self.kinds[kind] = len(self.kinds)
            if i >= len(self.word):
                self.scores, self.word, self.letter, self.single, self.number, self.sign = (np.concatenate([x, np.zeros_like(x)]) for x in (self.scores, self.word, self.letter, self.single, self.number, self.sign))
            self._score(i, features(kind))
            core = kind.rstrip()
            if core[:1].isupper() and core.replace("-", "").replace("'", "").replace("’", "").isalpha():
                folded = fold(core)
                self.letter[i], self.single[i] = ord(folded[0]), len(core) == 1
                if len(core) > 2:
                    self.word[i] = self._word(folded)
            self.number[i] = core != MAIL and any(c.isdigit() for c in core)
            self.sign[i] = 1 if core == "." else 2 if core == "," else 0
        if len(token) <= 6 or not any(c.isdigit() for c in kind) and not kind.startswith(MAIL):
            self.raw[token] = i  # kinds of numbers and mail addresses are few, their texts are not
        return i

    def ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Kinds of all tokens, with REACH edges after each text and before the first; where each text begins."""
        if len(self.raw) > 1_000_000 or len(self.kinds) > 1_000_000:
            self.clear()
        get, of, edge = self.raw.get, self.kind_of, [0] * REACH
        flat, starts = list(edge), []
        for tokens in texts:
            starts.append(len(flat))
            own = list(map(get, tokens))
            if None in own:
                own = [of(t) if i is None else i for i, t in zip(own, tokens, strict=True)]
            flat += own
            flat += edge
        return np.asarray(flat, np.int64), np.asarray(starts, np.int64)

    def local(self, ids: np.ndarray) -> np.ndarray:
        """Each token's score by itself and its neighbours."""
        score = np.zeros((len(ids), self.k), np.float32)
        for o in range(-REACH, REACH + 1):
            part = self.scores[:, o + REACH][ids]
            if o > 0:
                score[:-o] += part[o:]
            elif o:
                score[-o:] += part[:o]
            else:
                score += part
        return score

    def edges(self, ids: np.ndarray, starts: np.ndarray, at: np.ndarray, texts: list[list[str]]) -> Edges:
        """The skip edges among the tokens at the given places, as indices into at."""
        text = np.searchsorted(starts, at, side="right") - 1
        word = self.word[ids]
        own, n = word[at], len(self.words) + 1
        some = np.flatnonzero(own > 0)
        keys = [(0, some, text[some] * n + own[some])]
        # similar: words of a text that share a spelling are one cluster
        pairs = np.unique(text[some] * n + own[some])
        cluster = np.zeros(0, np.int64)
        if len(pairs):
            root = list(range(len(pairs)))

            def find(i: int) -> int:
                while root[i] != i:
                    root[i] = i = root[root[i]]
                return i

            # every spelling of every word of a text; equal ones come together in order
            ends = np.asarray(self.shared_ends)
            w = pairs % n
            count = ends[w] - ends[w - 1]
            of_pair = np.repeat(np.arange(len(pairs)), count)
            flat = np.asarray(self.shared)[np.repeat(ends[w] - np.cumsum(count), count) + np.arange(count.sum())]
            code = (pairs // n)[of_pair] * len(self.keys) + flat
            order = np.argsort(code, kind="stable")
            equal = np.flatnonzero(np.diff(code[order]) == 0)
            joined = np.unique(of_pair[order[equal]] * len(pairs) + of_pair[order[equal + 1]])
            for x, y in zip((joined // len(pairs)).tolist(), (joined % len(pairs)).tolist(), strict=True):
                if (a := find(x)) != (b := find(y)):
                    root[b] = a
            merged = len(joined) > 0
            if merged:
                cluster = np.array([find(i) for i in range(len(pairs))])
                many = np.bincount(cluster, minlength=len(pairs)) > 1
                of = cluster[np.searchsorted(pairs, text[some] * n + own[some])]
                keys.append((1, some[many[of]], of[many[of]]))
        # initial: H. Gorsby with Haleth Gorsby and Gorsby, Haleth
        letter, sign = self.letter[ids], self.sign[ids]
        short = np.flatnonzero(self.single[ids[at]])
        short = short[(sign[at[short] + 1] == 1) & (word[at[short] + 2] > 0)]
        if len(short):
            before = some[word[at[some] + 1] > 0]
            after = some[(sign[at[some] - 1] == 2) & (word[at[some] - 2] > 0)]
            key = lambda i, surname: (text[i] * n + surname) * 0x110000 + letter[at[i]]
            tokens = np.concatenate([short, before, after])
            every = np.concatenate([key(short, word[at[short] + 2]), key(before, word[at[before] + 1]), key(after, word[at[after] - 2])])
            hit = np.isin(every, every[: len(short)])
            keys.append((2, tokens[hit], every[hit]))
        # number
        numbers, labels = np.flatnonzero(self.number[ids[at]]), []
        where = at[numbers]
        for i, t, off, left, right in zip(numbers.tolist(), text[numbers].tolist(), (where - starts[text[numbers]]).tolist(), word[where - 1].tolist(), word[where + 1].tolist(), strict=True):
            digits = _NO_DIGIT.sub("", texts[t][off])
            labels.append((t, digits) if len(digits) >= LONG_NUMBER else (t, digits, right or left) if right or left else (t, digits, -1, i))
        number_of: dict[tuple, int] = {}
        keys.append((3, numbers, np.array([number_of.setdefault(x, len(number_of)) for x in labels], np.int64)))
        return grouped(keys)

    def marginals(self, texts: list[list[str]], rounds: int = ROUNDS, prune: float = PRUNE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places of the tokens that aren't pruned, their label marginals, whether a token begins a run, where texts begin)."""
        ids, starts = self.ids(texts)
        score = self.local(ids)
        at = np.flatnonzero((score[:, 1:].max(axis=1) - score[:, 0] > -prune) & (ids > 0))
        if not len(at):
            return at, np.zeros((0, self.k), np.float32), np.zeros(0, bool), starts
        score = score[at]
        first = np.ones(len(at), bool)
        first[1:] = np.diff(at) != 1
        begin = np.flatnonzero(first)
        length = np.diff(np.append(begin, len(at)))
        groups = in_buckets(length)
        p = chain(score, begin, length, groups, self.step, np.empty_like(score))
        if rounds and self.skip.any():
            edges = self.edges(ids, starts, at, texts)
            touched = np.bincount((np.cumsum(first) - 1)[edges.token], minlength=len(begin)) > 0
            again = [(size, r[touched[r]]) for size, r in groups]
            said = np.zeros((len(edges.token), self.k))
            for _ in range(rounds if len(edges.token) else 0):
                said, told, _ = spoken(p, score, said, edges, self.skip)
                p = chain(told, begin, length, again, self.step, p)
        return at, p, first, starts

    def spans(self, texts: list[list[str]], rounds: int = ROUNDS, prune: float = PRUNE) -> Iterator[tuple[int, int, int, int]]:
        """(text, first token, end token, label) of all entities, in order."""
        at, p, first, starts = self.marginals(texts, rounds, prune)
        label = (p * np.where(np.arange(self.k) > 0, MISS_COST, 1)).argmax(axis=1)
        new = first.copy()
        new[1:] |= label[1:] != label[:-1]
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(at))[label[begin] > 0]
        begin = begin[label[begin] > 0]
        text = np.searchsorted(starts, at[begin], side="right") - 1
        off = at[begin] - starts[text]
        yield from zip(text.tolist(), off.tolist(), (off + end - begin).tolist(), label[begin].tolist(), strict=True)


def spoken(p: np.ndarray, score: np.ndarray, said: np.ndarray, edges: Edges, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round of messages: what each membership is told by its group, scores with it, and what each thinks without it."""
    count = edges.size[edges.group][:, None]
    cavity = np.log(np.maximum(p[edges.token], 1e-9)) - said / (count - 1)  # less what one other token said
    cavity = np.exp(cavity - cavity.max(axis=1, keepdims=True))
    cavity /= cavity.sum(axis=1, keepdims=True)
    message = np.log1p(np.expm1(skip[edges.kind] * edges.scale()[:, None]) * cavity)
    labels = range(p.shape[1])
    total = np.stack([np.bincount(edges.group, weights=message[:, y], minlength=len(edges.size)) for y in labels], axis=1)
    said = total[edges.group] - message
    told = score + np.stack([np.bincount(edges.token, weights=said[:, y], minlength=len(score)) for y in labels], axis=1).astype(score.dtype)
    return said, told, cavity


def in_buckets(length: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(padded length, runs): runs of about equal length."""
    width = np.array([*range(1, 9), *(int(2 ** (x / 2)) for x in range(7, 64))])
    bucket = np.searchsorted(width, length)
    return [(int(width[b]), np.flatnonzero(bucket == b)) for b in np.unique(bucket)]


def chain(score: np.ndarray, begin: np.ndarray, length: np.ndarray, groups: list[tuple[int, np.ndarray]], step: np.ndarray, out: np.ndarray, expected: np.ndarray | None = None) -> np.ndarray:
    """Marginals of the runs in groups, written into out; the expected steps are added to expected."""
    e = np.exp(score - score.max(axis=1, keepdims=True))
    e = np.maximum(e, 1e-12)
    nothing = np.zeros(score.shape[1], score.dtype)
    nothing[0] = 1
    e = np.concatenate([e, nothing[None]])  # what pads a run is nothing, as is what follows it
    for width, members in groups:
        if not len(members):
            continue
        where = begin[members][:, None] + np.arange(width)
        inside = np.arange(width) < length[members][:, None]
        p, _, pairs = forward_backward(e[np.where(inside, where, len(score))], step, expected is not None)
        out[where[inside]] = p[inside]
        if expected is not None:
            expected += pairs
            expected[0, 0] -= (~inside).sum()
    return out


def bare(kind: str, text: str) -> tuple[int, int] | None:
    """Where in its tokens an entity's value is: without outer signs, but for those that begin a telephone number."""
    opening = "+(" if kind == "phone" else ""
    start, stop = 0, len(text)
    while start < stop and not (text[start].isalnum() or text[start] in opening):
        start += 1
    while stop > start and not text[stop - 1].isalnum():
        stop -= 1
    return (start, stop) if start < stop else None


def entities(tagger: Tagger, texts: list[str], rounds: int = ROUNDS, prune: float = PRUNE) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of the entities of each text, as places in the text."""
    tokens = [tokens_of(t) for t in texts]
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    current, upto, pos = -1, 0, 0
    for text, a, b, label in tagger.spans(tokens, rounds, prune):
        own = tokens[text]
        if text != current:
            current, upto, pos = text, 0, len(texts[text]) - len(texts[text].lstrip())
        pos += sum(map(len, own[upto:a]))
        value = "".join(own[a:b])
        if (inner := bare(LABELS[label], value)) is not None:
            out[text].append((pos + inner[0], pos + inner[1], LABELS[label]))
        pos, upto = pos + len(value), b
    return out


def load_model(path: str | Path = MODEL) -> dict:
    return json.loads(Path(path).read_text())


def find_personal(docs: DataFrame, key: str = "doc_id", text: str = "text", redact: bool = True, model: dict | None = None) -> DataFrame:
    """(key, redacted, found): the text with typed placeholders such as [NAME], and the entities as an array of (kind, val).

    val is written as in the text, with each run of white space as one space, and occurs once per distinct value. The
    rest of the text is unchanged. Null texts give null and no entity; empty texts give themselves; texts are labelled
    whole, whatever their length; rows that repeat are each labelled; other columns are ignored. One pass, no shuffle;
    redacted is null if redact is False.
    """
    model = model or load_model()
    kind = docs.schema[key].dataType.simpleString()

    def label(tagger: Tagger, batch: list[tuple]) -> tuple[list, list, list]:
        keys, texts = [b[0] for b in batch], [b[1] for b in batch]
        out, found = [], []
        for t, spans in zip(texts, entities(tagger, [t or "" for t in texts]), strict=True):
            found.append([{"kind": k, "val": v} for k, v in dict.fromkeys((k, " ".join(t[a:b].split())) for a, b, k in spans)])
            if not redact or t is None:
                out.append(None)
                continue
            parts, at = [], 0
            for a, b, k in spans:
                parts += [t[at:a], f"[{k.upper()}]"]
                at = b
            out.append("".join([*parts, t[at:]]))
        return keys, out, found

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("val", pa.string())]))

        def emit(held: list[tuple], type_: pa.DataType) -> pa.RecordBatch:
            keys, out, found = label(tagger, held)
            return pa.RecordBatch.from_arrays([pa.array(keys, type_), pa.array(out, pa.string()), pa.array(found, kinds)], names=[key, "redacted", "found"])

        gc.freeze()  # the weights are never garbage
        for batch in batches:
            held, size = [], 0
            for k, t in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                held.append((k, t))
                size += len(t or "")
                if size >= CHUNK_CHARS:
                    yield emit(held, batch[0].type)
                    held, size = [], 0
            if held:
                yield emit(held, batch[0].type)

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, redacted STRING, found ARRAY<STRUCT<kind: STRING, val: STRING>>")


def found(docs: DataFrame, key: str = "doc_id", text: str = "text", model: dict | None = None) -> DataFrame:
    """(key, kind, val): the distinct entities of each text."""
    return find_personal(docs, key, text, redact=False, model=model).select(key, F.inline("found"))
