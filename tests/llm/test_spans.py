import random
from collections import defaultdict

import numpy as np
import pytest

from grafloom.llm import spans
from grafloom.llm.spans import Passages, linked_pairs, rolling_hashes, shared_amount, shared_spans, shared_stretch, winnow

spans_before = spans._occurrences
ALPHABET = "abcdefghij ,.é😀"


def random_text(rng, n, alphabet=ALPHABET):
    return "".join(rng.choices(alphabet, k=n))


def test_hashes_depend_on_content_alone():
    codes = np.frombuffer("xxabcabcyyabc".encode("utf-32-le"), dtype=np.uint32)
    h = rolling_hashes(codes, 3)
    assert h[2] == h[5] == h[10] and len(set(h.tolist())) == len(h) - 2


def test_every_window_holds_a_phrase_chosen_alike():
    rng = random.Random(1)
    shared = random_text(rng, 60)
    texts = [random_text(rng, 100) + shared + random_text(rng, 77), shared, random_text(rng, 5) + shared, "short", "", "ab" * 200]
    index, pos, hashes = winnow(texts, 50, 20)
    for i, t in enumerate(texts):
        own = np.sort(pos[index == i])
        for w in range(len(t) - 49):
            assert any(w <= p <= w + 30 for p in own)
    chosen = [{p - t.index(shared) for p in pos[index == i] if t.index(shared) <= p <= t.index(shared) + 40} for i, t in enumerate(texts[:3])]
    assert chosen[0] & chosen[1] & chosen[2]


def test_long_texts_in_pieces():
    rng = random.Random(2)
    shared = random_text(rng, 300)
    text = random_text(rng, 262_000) + shared + random_text(rng, 300_000)
    index, pos, hashes = winnow([text, shared], 200, 80)
    own = np.sort(pos[index == 0])
    assert np.diff(own).max() <= 121 and set(hashes[index == 1]) <= set(hashes[index == 0])


def test_automata_find_all():
    assert sorted(Passages(["abc", "bca"], [7, 8]).find("abcabcx")) == [(7, 0, 3), (7, 3, 3), (8, 1, 3)]
    assert list(Passages([], []).find("abc")) == [] and list(Passages(["abc"], [1]).find("")) == []
    rng = random.Random(9)
    texts = [random_text(rng, 200, "abc .") for _ in range(9)]
    words = list({t[i : i + 5] for t in texts for i in range(0, 190, 7)})
    for t in texts:
        assert sorted(Passages(words, words).find(t)) == sorted((w, i, 5) for w in words for i in range(len(t)) if t.startswith(w, i))


def test_stretch():
    a, b = (np.array([list(map(ord, s))]) for s in ("xxabcyz", "zxabcyy"))
    left, right = shared_stretch(a, b, 2, 2)
    assert (left[0], right[0]) == (1, 1)


def brute(docs, n):
    seen, cover = defaultdict(set), defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - n + 1):
            seen[t[i : i + n]].add((d, i))
    pairs = set()
    for places in seen.values():
        own = {d for d, _ in places}
        if len(own) > 1:
            pairs |= {(a, b) for a in own for b in own if a < b}
            for d, i in places:
                cover[d] |= set(range(i, i + n))
    return pairs, {d: len(c) for d, c in cover.items()}


def corpus(seed, n_docs=60):
    rng = random.Random(seed)
    passages = [random_text(rng, k) for k in (38, 39, 40, 41, 60, 150)]
    docs = [(i, random_text(rng, rng.randint(0, 120)) + "".join(rng.choice(passages) + random_text(rng, rng.randint(0, 9)) for _ in range(rng.randint(0, 3)))) for i in range(n_docs)]
    docs += [(100 + i, docs[i % 7][1]) for i in range(10)]  # copies
    docs += [(200, None), (201, ""), (202, "a" * 300), (203, "b" + "a" * 60), (204, "ab" * 90), (205, "short")]
    return docs


@pytest.mark.parametrize("seed, direct, shard, routed", [(1, 64, 1000, False), (2, 64, 3, False), (3, 3, 1000, True), (4, 0, 1000, False)])
def test_exact(spark, seed, direct, shard, routed):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, "clash", 0) for d, t in docs] + [(*docs[3], "again", 1)], "doc_id bigint, text string, doc string, pos int")
    links, members, found = shared_spans(df, "doc_id", "text", min_chars=40, phrase_chars=16, direct_limit=direct, shard_phrases=shard, routed=routed)
    pairs, cover = brute(docs, 40)
    got = [tuple(r) for r in linked_pairs(links, members).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    amounts = {r["doc_id"]: r for r in shared_amount(df, "doc_id", "text", members, found, min_chars=40).collect()}
    assert len(amounts) == len(docs)
    assert {d: r["shared_chars"] for d, r in amounts.items() if r["shared_chars"]} == cover


def test_occurrences_come_from_the_automata(spark, monkeypatch):
    passage = random_text(random.Random(5), 250)
    df = spark.createDataFrame([(i, f"{i} " * i + passage + f" {i}") for i in range(3)], "doc_id bigint, text string")
    assert shared_spans(df, "doc_id", "text")[0].count() == 3
    monkeypatch.setattr(spans, "_occurrences", lambda texts, path, *rest: spans_before(texts.limit(1), path, *rest))
    assert shared_spans(df, "doc_id", "text")[0].count() == 0


def test_documents_pass_only_through_the_shards_of_their_phrases(spark, monkeypatch):
    rng = random.Random(11)
    passages = [random_text(rng, 150) for _ in range(40)]
    docs = [(i, random_text(rng, rng.randint(0, 30)) + passages[i % 40] + random_text(rng, 30)) for i in range(120)] + [(200 + i, random_text(rng, 200)) for i in range(80)]
    docs.append((300, docs[0][1]))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    streams, limits = [], dict(min_chars=40, phrase_chars=16, shard_phrases=32)

    def noted(texts, path, shards, *rest):
        streams.append((texts.select("doc", *({"shard"} & set(texts.columns))).collect(), shards))
        return spans_before(texts, path, shards, *rest)

    monkeypatch.setattr(spans, "_occurrences", noted)
    links, members, _ = shared_spans(df, "doc_id", "text", **limits)
    assert {tuple(r) for r in linked_pairs(links, members).collect()} == brute(docs, 40)[0]
    [(visits, shards)] = streams
    assert shards > 10  # each of 200 texts passed through all of them
    assert len(visits) == len(set(visits)) and {r[0] for r in visits} == {*range(120)}
    assert len(visits) < 120 * 5


def test_blocks_of_a_text_and_equal_texts_in_shards(spark):
    rng = random.Random(12)
    whole = random_text(rng, 6_000)
    docs = [(1, whole), (2, whole), (3, "x" + whole), (4, whole[2_000:2_300]), (4, whole[3_000:3_300]), (5, whole[2_990:3_310])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for routed in (None, False):
        links, members, found = shared_spans(df, "doc_id", "text", min_chars=40, phrase_chars=16, shard_phrases=24, routed=routed)
        assert {tuple(r) for r in linked_pairs(links, members).collect()} == brute(docs, 40)[0]
        amounts = {r["doc_id"]: r["shared_chars"] for r in shared_amount(df.where("doc_id <> 4"), "doc_id", "text", members, found, min_chars=40).collect()}
        assert amounts == {1: 6_000, 2: 6_000, 3: 6_000, 5: 320}


def test_nothing_shared(spark):
    df = spark.createDataFrame([(1, "x" * 10), (2, None)], "doc_id bigint, text string")
    for rows in (df, df.limit(0)):
        links, members, found = shared_spans(rows, "doc_id", "text")
        assert links.count() == members.count() == found.count() == 0
        assert {r["shared_part"] for r in shared_amount(rows, "doc_id", "text", members, found).collect()} <= {0.0}
