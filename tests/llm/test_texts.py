"""Packing, leaks and personal information."""

import bisect
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from varilake.llm import leaks, packing, pii, pii_train

# ---- packing


def test_fullest_is_best():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        room = rng.randint(0, 60)
        left = np.bincount(sizes, minlength=61) if sizes else np.zeros(61, int)
        chosen = packing.fullest(left, room)
        total = sum(s * n for s, n in chosen.items())
        want = max((sum(c) for r in range(len(sizes) + 1) for c in itertools.combinations(sizes, r) if sum(c) <= room), default=0)
        assert total == want and all(n <= left[s] for s, n in chosen.items())


@pytest.mark.parametrize("capacity", [1, 7, 100, 1024])
def test_pack_places_every_item_once(capacity):
    rng = np.random.default_rng(2)
    for sizes in (rng.integers(1, capacity + 1, 500), np.full(300, capacity), np.full(301, max(1, capacity // 2)), np.zeros(0, int)):
        bins = packing.pack(sizes, capacity)
        assert len(bins) == len(sizes)
        if len(sizes):
            assert np.bincount(bins, weights=sizes).max() <= capacity and set(bins) == set(range(bins.max() + 1))


def best_fit(sizes, capacity):
    rooms = []
    for x in sorted(sizes, reverse=True):
        i = bisect.bisect_left(rooms, x)
        bisect.insort(rooms, (rooms.pop(i) if i < len(rooms) else capacity) - x)
    return len(rooms)


@pytest.mark.parametrize("capacity", [256, 1024, 4096])
def test_pack_is_no_worse_than_best_fit(capacity):
    rng = np.random.default_rng(5)
    for spread in (0.6, 1.0, 1.4):
        sizes = np.clip(np.exp(rng.normal(np.log(capacity / 3), spread, 2000)).astype(int), 1, capacity)
        assert packing.pack(sizes, capacity).max() + 1 <= best_fit(sizes.tolist(), capacity)


def filled(spark, texts, plan, **kw):
    docs = spark.createDataFrame(texts, "doc_id BIGINT, text STRING").withColumn("n_tokens", F.lit(1)).withColumn("bin", F.lit("x"))
    targets = spark.createDataFrame(plan, "target_id INT, label STRING, capacity_tokens INT")
    return packing.fill_containers(docs, targets, **kw).collect()


def test_fill_containers(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice(["the", "court", "finds", "x7", "é"]) for _ in range(int(300 ** rng.random())))) for i in range(400)] + [(900, None), (901, ""), (902, "word " * 20_000), (903, "word " * 20_000), (904, "<|endoftext|>")]
    plan = [(1, "short", 64), (2, "long", 1024)]
    rows = filled(spark, texts, plan, shard_items=100)
    tokens = {i: len(packing._encoder(packing.read_vocabulary()).encode_ordinary(t)) for i, t in texts if t}
    for target, _, capacity in plan:
        mine = [r for r in rows if r["target_id"] == target]
        bins, docs = defaultdict(int), defaultdict(list)
        for r in mine:
            bins[r["bin"]] += r["n_tokens"]
            docs[r["doc_id"]].append((r["first_token"], r["n_tokens"], r["piece"]))
        assert max(bins.values()) <= capacity
        assert set(docs) == set(tokens)
        for d, parts in docs.items():
            parts.sort()
            assert sum(n for _, n, _ in parts) == tokens[d] and [f for f, _, _ in parts] == [capacity * p for p in range(len(parts))]
            assert len(parts) == 1 or tokens[d] > capacity
        least = max(sum(bins.values()) / capacity, sum(2 * r["n_tokens"] > capacity for r in mine))  # no two larger halves share a container
        assert len(bins) <= 1.02 * least + 1
    assert filled(spark, texts, plan, shard_items=100) is not None and {tuple(r) for r in filled(spark, texts, plan, shard_items=100)} == {tuple(r) for r in rows}


def test_shards_cost_next_to_nothing(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, "word " * int(900 ** rng.random())) for i in range(3000)], "doc_id BIGINT, text STRING")
    plan = spark.createDataFrame([(1, "a", 256), (2, "b", 1024)], "target_id INT, label STRING, capacity_tokens INT")
    one, many = ({r["target_id"]: r for r in packing.fill_report(docs, plan, shard_items=n).collect()} for n in (10**6, 150))
    for t in one:
        assert one[t]["least"] == many[t]["least"] <= one[t]["containers"] <= many[t]["containers"] <= 1.01 * one[t]["containers"] + 1


def test_fill_containers_edges(spark):
    assert filled(spark, [], [(1, "a", 8)]) == [] and filled(spark, [(1, "a b c")], []) == []
    rows = filled(spark, [(1, "a b c"), (1, "a b c")], [(1, "a", 8)])
    assert len(rows) == 2 and sum(r["n_tokens"] for r in rows) == 6
    with pytest.raises(ValueError):
        filled(spark, [(1, "a")], [(1, "a", None)])
    # items that never fill a container do not make the rounds endless
    assert len(filled(spark, [(i, "word " * 40) for i in range(90)], [(1, "a", 64)], shard_items=10)) == 90


# ---- leaks


def edit_distance_anywhere(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != w)))
        row = new
        best = min(best, row[-1])
    return best


def test_myers():
    rng = random.Random(1)
    for _ in range(500):
        pattern = [rng.choice("abc") for _ in range(rng.randint(1, 14))]
        text = [rng.choice("abcd") for _ in range(rng.randint(0, 20))]
        assert leaks.myers(pattern, text) == edit_distance_anywhere(pattern, text)


def words(t):
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))


def leaked(docs, items, edits=0):
    out = set()
    for d, t in docs:
        for i, it in items:
            if t is None or it is None or i is None:
                continue
            w, p = words(t), words(it)
            if any(edit_distance_anywhere(p[a : a + 12], w) <= edits for a in range(len(p) - 11)):
                out.add((d, i))
    return out


def searched(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id BIGINT, text STRING").withColumn("item_id", F.lit(1)).withColumn("edits", F.lit(1))
    rows = leaks.leaks(d, spark.createDataFrame(items, "item_id BIGINT, text STRING"), **kw).collect()
    assert len(rows) == len({(r[0], r[1]) for r in rows})
    return {(r[0], r[1]) for r in rows}


def test_leaks_cases(spark):
    item = "Suppose a ferryman from Upper Farrley burns peat, beside a thatched barn; and after 372 days frost cracks the pipe"
    w = words(item)
    docs = [(1, f"x {' '.join(w[3:15])} y"), (2, f"x {' '.join(w[3:14])} y"), (3, "–".join(w[8:]).upper()), (4, None), (5, ""), (6, item), (7, "Supposeéa ferryman " + item[19:]), (8, " ".join(w[:6] + ["no"] + w[6:])), (9, "lorem " * 300_000 + " ".join(w[5:17]))]
    items = [(10, item), (11, "too short to leak"), (12, None), (13, ""), (14, item), (15, 'one two'), (15, item), (15, 'x ' * 20)]
    got = searched(spark, docs, items)
    assert got == leaked(docs[:8], items) | {(9, 10), (9, 14), (9, 15)} and (1, 10) in got and (2, 10) not in got
    assert searched(spark, docs, items, block_chars=1) == got == searched(spark, docs * 2, items) == searched(spark, docs * 2, items * 2, block_chars=1)
    assert searched(spark, [], items) == set() == searched(spark, docs, [])


def test_hashes_do_not_depend_on_the_place():
    powers = leaks.Powers()
    a, b = leaks.normalized("one two three four five"), leaks.normalized("zero; ONE two three four five six")
    assert list(powers.pieces(a, 3)) == list(powers.pieces(b, 3))[1:4] and len(powers.pieces(a, 6)) == 0 == len(powers.pieces(" ", 1))
    words = [f"w{i % 97}x{i}" for i in range(20_000)]
    assert len(set(powers.pieces(leaks.normalized(" ".join(words)), 4).tolist())) == 19_997


def test_leaks_of_many_pieces_take_several_passes(spark, monkeypatch):
    monkeypatch.setattr(leaks, "HASHED_PIECES", 2)
    items = [(i, " ".join(f"k{i}v{j}" for j in range(20))) for i in range(6)]
    docs = [(d, " ".join(f"k{d}v{j}" for j in range(3, 17))) for d in range(8)]
    assert searched(spark, docs, items, block_chars=1) == {(i, i) for i in range(6)}


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_leaks_random(spark, edits):
    rng = random.Random(edits)
    word = lambda: rng.choice("ab cd ef gh ij kl mn".split())
    items = [(i, " ".join(word() for _ in range(rng.randint(10, 30)))) for i in range(12)]
    docs = []
    for d in range(60):
        body = [word() for _ in range(40)]
        p = words(rng.choice(items)[1])
        a = rng.randrange(max(1, len(p) - 12))
        part = p[a : a + rng.randint(9, 14)]
        for _ in range(rng.randint(0, 3)):
            part[rng.randrange(len(part))] = "zz"
        docs.append((d, " ".join(body[:20] + part + body[20:])))
    assert searched(spark, docs, items, edits=edits) == leaked(docs, items, edits) == searched(spark, docs, items, edits=edits, block_chars=1)


# ---- personal information


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger(pii.load_model())


def test_tokens_cover_the_text():
    texts = ["", " a b\n\nc@d.example, (0)555 12-3 x", "jo (at) host.example and x [at] a [dot] b", "a@b", "@", "x at host dot tld", "O'Neill's l'eau Kest-Halb 12A 138 bis +99 (0)555 1", "éà 中文 \U0001f600", "a\n\nb", "\n \n a \n \n\n b\n\n", "(1)\n2 (22) 3"]
    for t in texts:
        assert "".join(pii.tokens_of(t)) == t.lstrip() or not t.strip()


def scores(found, want):
    hit = len(found & want)
    return hit / max(len(found), 1), hit / max(len(want), 1)


def rounds_apart(tagger, rounds):
    data = pii_train.corpus(250, 99)
    found = {(d, a, b, k) for d, spans in enumerate(pii.entities(tagger, [t for t, _ in data], rounds)) for a, b, k in spans}
    return scores(found, {(d, a, b, k) for d, (_, spans) in enumerate(data) for a, b, k in spans})


def test_held_out_accuracy(tagger):
    """Texts of the trainer's forms that it has not seen; the skip edges add to both precision and recall."""
    (p0, r0), (p2, r2) = rounds_apart(tagger, 0), rounds_apart(tagger, pii.ROUNDS)
    assert p2 > 0.95 and r2 > 0.95
    assert p2 > p0 and r2 > r0 + 0.008


EVERYDAY = """
If the heating fails again, ring [Marta Lindqvist|name] straight away, her mobile is [+46 70 123 45 67|phone].
Booking confirmed for [Tobias Kerr|name]; a receipt went to [tobias.kerr@posteo.net|email].
I think [john.smith@gmail.com|email] bounced, try [a.merkel@bundestag.de|email] instead.
The president lives at [1600 Pennsylvania Avenue|address], which surprises nobody.
Please send the keys to [5 Elm Road|address], not to the office in London.
Their campus is at [77 Massachusetts Ave|address] in Cambridge.
Passport [K1234567|id_number] was reported stolen.
He gave his social security number as [123-45-6789|id_number] without hesitation.
Dr. [Gonzalez-Lopez|name] referred the child to a specialist.
[John Smith|name] bought three tickets for Friday.
Minutes taken by [Ingrid Haugen|name], approved by [Paul Okafor|name].
My sister [Rosa Delgado|name] teaches maths in Madrid.
Could somebody tell Mr. [Abernathy|name] that his car is blocking the gate?
The landlord, [Piotr Zielinski|name], never answers [0171 5550142|phone].
Reply to [support-team@cityhall.org|email] by Monday.
Mum's new place is [18 Orchard Lane|address], second house on the left.
Our suspect, [Leon Baptiste|name], used the tax number [12 345 678 901|id_number].
Fax the form to [(212) 555-7788|phone] before noon.
[Hannah Wolff|name] and [Samir Haddad|name] share the prize.
Mrs [Okonkwo|name] thanked Mr [Tremblay|name] for the flowers.
Reference 88231 has nothing to do with Berlin or Paris.
Train 402 leaves at 9:15 from platform 12 and costs 45 euros.
The Harrison Foundation and Globex Corp will merge in March.
Invoice 20391122 is still open.
Herr [Baumgartner|name] kommt morgen, seine Nummer ist [030 5551234|phone].
Bitte an [Sonja Reuter|name], [Lindenallee 14|address], liefern.
Meine Adresse lautet [Bergstraße 7a|address], 50667 Cologne.
Personalausweis [L01X00T47|id_number] ist abgelaufen.
Madame [Leclerc|name] habite [12 rue des Lilas|address] depuis 1998.
Vous pouvez joindre [Thierry Blanc|name] au [01 44 55 66 77|phone].
Envoyez tout à [claire.martin@orange.fr|email], merci.
The nurse wrote down [555-0134|phone] on her hand.
[A. Petrova|name] did not sign, but [Petrova, Anna|name] appears on the list.
Deliver the piano to [221B Baker Street|address] on Tuesday.
National insurance number [QQ 12 34 56 C|id_number] belongs to her.
You will find Ms. [Nakamura|name] in room 204.
Write him at [k_lee (at) mail.example.com|email] if you dare.
The witness [Dmitri Volkov|name] spoke through an interpreter.
It was [Grace Adeyemi|name] who found the dog near Lake Wilson.
Emergency? Dial [1-800-555-0199|phone] and ask for [Carlos Mendes|name].
"""


def test_forms_the_trainer_never_saw(tagger):
    hit = found = want = 0
    for line in EVERYDAY.strip().splitlines():
        text, spans = "", set()
        for part in re.split(r"(\[[^\]|]+\|\w+\])", line):
            if m := re.fullmatch(r"\[([^|]+)\|(\w+)\]", part):
                spans.add((len(text), len(text) + len(m[1]), m[2]))
                text += m[1]
            else:
                text += part
        got = set(pii.entities(tagger, [text])[0])
        hit, found, want = hit + len(got & spans), found + len(got), want + len(spans)
    assert hit / want > RECALL and hit / found > 0.9


RECALL = 0.75


def test_pruning_changes_next_to_nothing(tagger):
    texts = [t for t, _ in pii_train.corpus(300, 97)]
    pruned, whole = ({(d, *e) for d, spans in enumerate(pii.entities(tagger, texts, prune=x)) for e in spans} for x in (pii.PRUNE, 1000))
    assert len(pruned ^ whole) <= 0.004 * len(whole)


def linked(tagger, text):
    """Kind of edge -> sets of token places that are linked."""
    tokens = [pii.tokens_of(text)]
    ids, starts = tagger.ids(tokens)
    at = np.flatnonzero(ids > 0)
    e = tagger.edges(ids, starts, at, tokens)
    out = defaultdict(set)
    for g in range(len(e.size)):
        members = e.token[e.group == g]
        assert len(members) == e.size[g] > 1
        out[pii.LINKS[e.kind[e.group == g][0]]].add(" ".join(sorted(tokens[0][at[i] - starts[0]].strip() for i in members)))
    return out


def test_edges(tagger):
    got = linked(tagger, "Haleth Gorsby met H. Gorsby and Gorsby, Haleth. Gorsbi called 0555 17 94 65, later 0555/179465. Kest-Halb, Halb. He lives at 12 Elm Road; 12 Elm Way, 12 cats.")
    assert got["same"] == {"Gorsby Gorsby Gorsby", "Haleth Haleth", "Elm Elm"}
    assert got["similar"] == {"Gorsbi Gorsby Gorsby Gorsby", "Halb Kest-Halb"}
    assert got["initial"] == {"H Haleth Haleth"}
    assert got["number"] == {"0555 17 94 65 0555/179465", "12 12"}
    assert not linked(tagger, "") and not linked(tagger, "Anna met Bob.")["same"]


def test_messages_are_those_of_all_pairs():
    """One round by sums over groups against messages sent along every edge."""
    rng = np.random.default_rng(2)
    k, n = len(pii.LABELS), 7
    score, skip = rng.normal(size=(n, k)), rng.normal(size=(len(pii.LINKS), k))
    p = np.exp(score)
    p /= p.sum(axis=1, keepdims=True)
    e = pii.grouped([(0, np.array([0, 1, 2, 3]), np.array([5, 5, 5, 9])), (2, np.array([2, 4]), np.array([1, 1]))])
    _, told, _ = pii.spoken(p, score, np.zeros((len(e.token), k)), e, skip)
    want = score.copy()
    for group, kind in (((0, 1, 2), 0), ((2, 4), 2)):
        weight = 1 / np.sqrt(len(group) - 1)
        for i, j in itertools.permutations(group, 2):
            want[j] += np.log([sum(p[i, x] * np.exp(weight * skip[kind, y] * (x == y)) for x in range(k)) for y in range(k)])
    assert np.allclose(told, want)


def test_chain_marginals_are_exact():
    rng = np.random.default_rng(1)
    e, step = rng.random((3, 4, 3)) + 0.1, rng.random((3, 3)) + 0.1
    p, log_z, pairs = pii.forward_backward(e, step, True)
    total = np.zeros((3, 3))
    for n in range(3):
        weight, z, q = {}, 0, np.zeros((4, 3))
        for y in itertools.product(range(3), repeat=4):
            path = [0, *y, 0]
            weight[y] = np.prod([step[a, b] for a, b in itertools.pairwise(path)]) * np.prod([e[n, t, y[t]] for t in range(4)])
        z = sum(weight.values())
        for y, w in weight.items():
            for t in range(4):
                q[t, y[t]] += w / z
            for a, b in itertools.pairwise([0, *y, 0]):
                total[a, b] += w / z
        assert np.allclose(p[n], q) and np.isclose(log_z[n], np.log(z))
    assert np.allclose(pairs, total)


def test_redaction(spark):
    text = "BETWEEN\nHaleth Gorsby, Appellant\n\n1 The tenant lived at 107 Copperas Lane until the spring; the landlord could be reached on 0555 17 94\n65. Messages from h.gorsby@lawdesk.example were produced. The payee was entered under tax number 99 958 776 596. Mr Gorsby's account stands."
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "No one here."), (1, text)], "doc_id BIGINT, text STRING").withColumn("kind", F.lit("x")).withColumn("val", F.lit(1))
    rows = pii.find_personal(docs).collect()
    out = {r["doc_id"]: r for r in rows}
    assert len(rows) == 5 and out[2]["redacted"] is None and out[2]["found"] == [] and out[3]["redacted"] == "" and out[4]["redacted"] == "No one here."
    assert {(f["kind"], f["val"]) for f in out[1]["found"]} == {("name", "Haleth Gorsby"), ("name", "Gorsby"), ("address", "107 Copperas Lane"), ("phone", "0555 17 94 65"), ("email", "h.gorsby@lawdesk.example"), ("id_number", "99 958 776 596")}
    assert out[1]["redacted"] == "BETWEEN\n[NAME], Appellant\n\n1 The tenant lived at [ADDRESS] until the spring; the landlord could be reached on [PHONE]. Messages from [EMAIL] were produced. The payee was entered under tax number [ID_NUMBER]. Mr [NAME]'s account stands."
    assert pii.found(docs.where("false")).count() == 0


def test_very_long_and_odd_texts(tagger):
    texts = ["Mr Gorsby agreed. " * 20_000, "a" * 500_000, "A " * 10_000, "1 " * 100_000, "@" * 50_000, "(" * 50_000, "\n" * 50_000, "A.B@" * 5_000, "1" + " " * 200_000 + "x", "x@" + "a-" * 100_000, "at " * 50_000 + " dot ", "[at" * 50_000]
    spans = pii.entities(tagger, texts)
    assert sum(k == "name" for _, _, k in spans[0]) == 20_000 and all(0 <= a < b <= len(t) for t, s in zip(texts, spans, strict=True) for a, b, _ in s)
