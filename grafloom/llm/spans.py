"""Long exact spans shared between documents.

Phrases that recur in several documents are confirmed by counting (winnowing
picks them, so that every window of min_chars characters holds one), compiled
into sharded Aho-Corasick automata, and the documents are streamed through the
shards (through all, or through those that can hold something of theirs), which
locates every occurrence. The surroundings of the occurrences decide which
documents share a span of min_chars characters or more.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, qualified, scratch_path, shared_files, whole_groups

MIN_CHARS = 200
PHRASE_CHARS = 80
#: Phrases of one automaton: it then takes some 80 MB in a Python worker.
SHARD_PHRASES = 32_000
#: Characters that are streamed through a shard before the next one is loaded.
BUFFER_CHARS = 16_000_000
#: Occurrences of one phrase that are compared with each other at once; the
#: occurrences of more frequent phrases are compared by window hashes.
DIRECT_LIMIT = 64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PIECE_BITS = 18
_PIECE = 1 << _PIECE_BITS
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, _PIECE + 4096)
        both = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[0] = (both[0], both[1])
    return _POWERS[0][0][:n], _POWERS[0][1][:n]


def rolling_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each stretch of width characters, the same wherever the
    stretch stands."""
    up, down = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = (sums[width:] - sums[:-width]) * down[: len(codes) - width + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every stretch of width keys."""
    m, w = keys, 1
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    rest = width - w
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def _pieces(texts: list[str], min_chars: int) -> Iterator[list[tuple[int, int, str]]]:
    """Groups of (index, offset, stretch of a text), each group short enough for
    one pass; long texts are cut so that every window lies within one piece."""
    group: list[tuple[int, int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - min_chars + 1), _PIECE - min_chars):
            piece = text[at : at + _PIECE - 1]
            if len(piece) < min_chars:
                continue
            if size + len(piece) >= _PIECE:
                yield group
                group, size = [], 0
            group.append((i, at, piece))
            size += len(piece)
    if group:
        yield group


def winnow(texts: list[str], min_chars: int = MIN_CHARS, phrase_chars: int = PHRASE_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, position, hash) of phrases such that every window of min_chars
    characters of a text holds one, chosen by what the window contains alone."""
    mask = np.uint64(_PIECE - 1)
    out: list[tuple[np.ndarray, ...]] = []
    for group in _pieces(texts, min_chars):
        codes = np.frombuffer("".join(p for _, _, p in group).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        hashes = rolling_hashes(codes, phrase_chars)
        keys = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
        lowest = _window_min(keys, min_chars - phrase_chars + 1)
        lengths = np.array([len(p) for _, _, p in group])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        whole = np.zeros(len(codes) + 1, dtype=np.int8)
        np.add.at(whole, starts, 1)
        np.add.at(whole, starts + lengths - min_chars + 1, -1)
        chosen = (lowest[np.cumsum(whole[:-1], dtype=np.int8)[: len(lowest)] > 0] & mask).astype(np.int64)
        if len(chosen):
            chosen = np.unique(chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])])
        at = np.searchsorted(starts, chosen, side="right") - 1
        index = np.array([i for i, _, _ in group])[at]
        out.append((index, chosen - starts[at] + np.array([o for _, o, _ in group])[at], hashes[chosen].view(np.int64)))
    if not out:
        return (np.zeros(0, dtype=np.int64),) * 3
    index, pos, hashes = (np.concatenate(x) for x in zip(*out))
    _, first = np.unique(index * (1 << 40) + pos, return_index=True)  # pieces of one text overlap
    return index[first], pos[first], hashes[first]


def _texts(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """(doc, key, text) of all texts that are long enough, with a hash of the
    text, and (doc, rep, key) of the documents whose texts are equal: rep is
    the one with the smallest id."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text")).where((F.length("text") >= min_chars) & F.col("doc").isNotNull()).withColumn("key", F.xxhash64("text"))
    keyed = rows.select("doc", "key", F.md5("text").alias("same"))
    groups = keyed.groupBy("same").agg(F.min("doc").alias("rep"), F.max("doc").alias("top")).where("rep < top").drop("top")
    return rows, materialize(keyed.join(groups, "same").select("doc", "rep", "key").distinct())


def _phrases(rows: DataFrame, min_chars: int, phrase_chars: int) -> DataFrame:
    """(key, phrase) of the phrases of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            index, _, hashes = winnow(batch.column(1).to_pylist(), min_chars, phrase_chars)
            yield pa.RecordBatch.from_arrays([pa.array(keys[index], pa.int64()), pa.array(hashes, pa.int64())], names=["key", "phrase"])

    return rows.select("key", "text").mapInArrow(run, "key bigint, phrase bigint")


def _recurring(phrases: DataFrame) -> DataFrame:
    """(phrase, key, first) of the phrases that stand in more than one text, with
    the first of these."""
    same = Window.partitionBy("phrase")
    rows = phrases.select("phrase", "key", F.min("key").over(same).alias("first"), F.max("key").over(same).alias("last"))
    return rows.where("first < last").select("phrase", "key", "first").distinct()


def _holders(rows: DataFrame, members: DataFrame, recurring: DataFrame, shards: int, shard_phrases: int, routed: bool) -> DataFrame:
    """(doc, text, wanted, shards) of the texts from which passages are taken,
    each once: wanted are their phrases and the shards these belong to. With
    routed, of all texts that hold a recurring phrase: shards are those of all
    phrases they hold. Phrases taken from one text go to one shard, so that
    texts which share much are in few; those of a text that would fill a large
    part of a shard are spread in blocks."""
    block = F.floor((F.row_number().over(Window.partitionBy("key").orderBy("phrase")) - 1) / max(1, shard_phrases // 8))
    placed = recurring.where("key = first").select("phrase", "key", F.pmod(F.xxhash64("key", block), F.lit(max(1, shards))).cast("int").alias("shard"))
    if routed:
        placed = recurring.join(placed.select("phrase", "shard"), "phrase").withColumn("own", F.col("key") == F.col("first"))
    else:
        placed = placed.withColumn("own", F.lit(True))
    held = placed.groupBy("key").agg(F.collect_list(F.when(F.col("own"), F.struct("phrase", "shard"))).alias("wanted"), F.collect_set("shard").alias("shards"))
    # Written, so that its size is known when the join with the texts is planned.
    held = materialize(held.join(members.select("key", "rep").distinct(), "key", "left"))
    return rows.join(held, "key").where("rep is null or doc = rep").select("doc", "text", "wanted", "shards")


def _passages(holders: DataFrame, min_chars: int, phrase_chars: int) -> DataFrame:
    """(phrase, passage, shard) of every wanted phrase: its hash and its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, asked = batch.column(0).to_pylist(), [{w["phrase"]: w["shard"] for w in own} for own in batch.column(1).to_pylist()]
            out: dict[int, tuple[str, int]] = {}
            for i, p, h in zip(*(x.tolist() for x in winnow(found, min_chars, phrase_chars))):
                if h in asked[i]:
                    out[h] = found[i][p : p + phrase_chars], asked[i][h]
            columns = [pa.array(out.keys(), pa.int64()), pa.array([t for t, _ in out.values()], pa.string()), pa.array([s for _, s in out.values()], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["phrase", "passage", "shard"])

    return holders.where(F.size("wanted") > 0).select("text", "wanted").mapInArrow(run, "phrase bigint, passage string, shard int")


def start_letters(passages: list[str], sample: int = 2_000) -> dict[str, int]:
    """Few and rare characters such that nearly every passage has one in its
    first half, with their rank. Automata of words that begin with few letters
    leave their root rarely, and are faster for it; which letters these are
    changes nothing in what is found, so that a sample will do."""
    left = [set(p[: len(p) // 2 + 1]) for p in passages[:sample]]
    common = Counter(c for p in passages[:sample] for c in p)
    whole, chosen = sum(common.values()) or 1, {}
    while left:
        held = Counter(c for own in left for c in own)
        best = max(held, key=lambda c: (held[c] / (common[c] / whole + 0.002), c))
        chosen[best] = len(chosen)
        left = [own for own in left if best not in own]
    return chosen


class Passages:
    """An automaton over the passages of one shard. Its words are the passages
    from one of the start letters on; what stands before it is compared."""

    def __init__(self, passages: list[str], values: list) -> None:
        rank = start_letters(passages)
        words: dict[str, list] = {}
        for passage, value in zip(passages, values):
            start = min(range(len(passage) // 2 + 1), key=lambda i: rank.get(passage[i], len(rank)))
            words.setdefault(passage[start:], []).append((passage, value))
        self.automaton = ahocorasick.Automaton()
        for word, those in words.items():
            self.automaton.add_word(word, those)
        if words:
            self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[object, int, int]]:
        """(value, position, length) of every occurrence of a passage in text."""
        for end, those in self.automaton.iter(text) if len(self.automaton) else ():
            for passage, value in those:
                at = end + 1 - len(passage)
                if at >= 0 and text.startswith(passage, at):
                    yield value, at, len(passage)


@lru_cache(maxsize=1)
def _shard(path: str, shard: int) -> Passages:
    """The automaton of one shard, from the passages in the shared folder."""
    system, folder = shared_files(path)
    if not system.get_file_info(f"{folder}/shard={shard}").type:  # no passage fell into it
        return Passages([], [])
    table = pq.read_table(f"{folder}/shard={shard}", filesystem=system, columns=["phrase", "passage"], partitioning=None)
    return Passages(table.column("passage").to_pylist(), table.column("phrase").to_pylist())


def _occurrences(texts: DataFrame, path: str, shards: int, min_chars: int, phrase_chars: int, buffer_chars: int = BUFFER_CHARS) -> DataFrame:
    """(phrase, doc, pos, before, around) of every occurrence of a passage in any
    text: around is it with up to min_chars - phrase_chars characters on either
    side, before of them in front. Every text passes through every shard; a
    worker holds one automaton and a buffer of texts at a time. Texts with a
    column shard pass through that one, and all of one follow each other."""
    margin = min_chars - phrase_chars
    names = ["phrase", "doc", "pos", "before", "around"]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())

    def stream(held: Iterable[tuple], order: Iterable[int]) -> Iterator[pa.RecordBatch]:
        for shard in order:
            passages = _shard(path, shard)
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text, *_ in held:
                for phrase, pos, length in passages.find(text):
                    at = max(0, pos - margin)
                    for column, x in zip(out, (phrase, doc, pos, pos - at, text[at : pos + length + margin])):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    def run_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, rows in groupby(zip(*(batch.column(i).to_pylist() for i in range(3))), key=lambda row: row[2]):
                yield from stream(rows, [shard])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        size, order = 0, range(shards)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((doc, text))
                size += len(text)
                if size >= buffer_chars:
                    yield from stream(held, order)
                    held, size, order = [], 0, order[::-1]  # the shard loaded last comes first
        yield from stream(held, order)

    schema = "phrase bigint, doc bigint, pos int, before int, around string"
    if "shard" in texts.columns:
        return texts.select("doc", "text", "shard").mapInArrow(run_own, schema)
    return texts.select("doc", "text").mapInArrow(run, schema)


def shared_stretch(a: np.ndarray, b: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of aligned character codes that agree in the middle: how many
    characters to the left and to the right of it agree without a break."""
    same = a == b
    left = np.cumprod(same[:, :before][:, ::-1], axis=1, dtype=np.int32).sum(axis=1)
    right = np.cumprod(same[:, -after:], axis=1, dtype=np.int32).sum(axis=1)
    return left, right


def _compare(occurrences: DataFrame, min_chars: int, phrase_chars: int) -> DataFrame:
    """(doc, other, start, end): spans of doc around an occurrence that other
    has too. A phrase's occurrences are compared directly."""
    margin = min_chars - phrase_chars
    width = min_chars + margin

    def compare(group: list[tuple[int, int, int, str]], out: tuple[list, ...]) -> None:
        n = len(group)
        if n < 2:
            return
        codes = np.zeros((n, width), dtype=np.uint32)
        for i, (_, _, before, around) in enumerate(group):
            c = np.frombuffer(around.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            codes[i, margin - before : margin - before + len(c)] = c + 1
        codes[:, :margin] += (codes[:, :margin] == 0) * (np.uint32(1 << 30) + np.arange(n, dtype=np.uint32)[:, None])  # what lies outside a text equals nothing
        codes[:, margin + phrase_chars :] += (codes[:, margin + phrase_chars :] == 0) * (np.uint32(1 << 30) + np.arange(n, dtype=np.uint32)[:, None])
        docs, pos = np.array([g[0] for g in group]), np.array([g[1] for g in group])
        i, j = np.triu_indices(n, 1)
        keep = docs[i] != docs[j]
        i, j = i[keep], j[keep]
        for s in range(0, len(i), 4096):
            a, b = i[s : s + 4096], j[s : s + 4096]
            left, right = shared_stretch(codes[a], codes[b], margin, margin)
            ok = (left + right + phrase_chars >= min_chars) & (codes[a, margin : margin + phrase_chars] == codes[b, margin : margin + phrase_chars]).all(axis=1)
            for x, y in ((a[ok], b[ok]), (b[ok], a[ok])):
                out[0].append(docs[x]), out[1].append(docs[y]), out[2].append(pos[x] - left[ok]), out[3].append(pos[x] + phrase_chars + right[ok])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, int, int, str]] = []
        phrase = None
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for p, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if p != phrase:
                    compare(group, out)
                    group, phrase = [], p
                group.append(tuple(row))
            yield _spans(out)
        out = ([], [], [], [])
        compare(group, out)
        yield _spans(out)

    return whole_groups(occurrences, ["phrase"], "phrase", "doc", "pos").mapInArrow(run, "doc bigint, other bigint, start int, end int")


def _spans(out: tuple[list, ...]) -> pa.RecordBatch:
    columns = [np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in out]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc", "other", "start", "end"])


def _windows(occurrences: DataFrame, min_chars: int) -> DataFrame:
    """(window, doc, start) of all windows around the occurrences of phrases
    that are too frequent to compare directly: equal windows have equal hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for doc, pos, before, around in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                for o in range(len(around) - min_chars + 1):
                    out[0].append(xxhash.xxh3_128_digest(around[o : o + min_chars].encode()))
                    out[1].append(doc)
                    out[2].append(pos - before + o)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int32()))], names=["window", "doc", "start"])

    return occurrences.mapInArrow(run, "window binary, doc bigint, start int").distinct()


def _window_links(windows: DataFrame) -> DataFrame:
    """(doc_a, doc_b) of documents that have a window in common. All windows of
    one passage stand in the same documents; such windows are one class, and
    pairs are formed once for each class. A class is told by two 64-bit sums of
    the hashes of its documents, their number, and the first and last of them."""
    own = windows.select("window", "doc").distinct()
    sums = [F.bit_xor(F.xxhash64("doc", F.lit(seed))).alias(f"h{seed}") for seed in (0, 1)]
    classes = own.groupBy("window").agg(F.count("*").alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b"), *sums)
    kept = classes.groupBy("n", "a", "b", "h0", "h1").agg(F.min("window").alias("window")).select("window")
    one = materialize(own.join(kept, "window"))
    return one.withColumnRenamed("doc", "doc_a").join(one.withColumnRenamed("doc", "doc_b"), "window").where("doc_a < doc_b").select("doc_a", "doc_b").distinct()


def shared_spans(docs: DataFrame, doc_id: str, text: str, *, min_chars: int = MIN_CHARS, phrase_chars: int = PHRASE_CHARS, direct_limit: int = DIRECT_LIMIT, shard_phrases: int = SHARD_PHRASES, routed: bool | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verbatim spans of min_chars or more characters that stand in more than
    one document.

    docs      doc_id (bigint) and text; other columns are ignored
    routed    whether a document passes only through the shards that hold a
              phrase of its own (see below); by default, where there are
              several shards
    returns   links (doc_a, doc_b), doc_a < doc_b: representatives whose texts
              share such a span; members (doc, rep): documents whose whole text
              occurs more than once, and their representative (the smallest
              id); spans (doc, start, end): stretches of a representative's
              text, from start to before end in characters, that overlap and
              touch, and together are all it shares with other representatives

    The result is exact: winnowing guarantees that every span of min_chars holds
    a phrase chosen alike in both texts; those in more than one document become
    the passages of the automata, which locate all their occurrences in all
    documents; their surroundings are compared character by character (or, for
    a passage with more than direct_limit occurrences, by 128-bit hashes of all
    windows around it, grouped by Spark; the result is the same). Phrases, and
    the texts they stand in, are told apart by 64-bit hashes.

    Automata are sharded by passage, so that none outgrows a worker. Where every
    document passes through all shards, the work is the text times the number
    of shards, which grows with the text as well. With routed, a document passes
    through each shard that holds one of the phrases winnowing picks in it. The
    result is the same, since of every shared span a phrase is picked in all
    documents that hold it, and these meet in that phrase's shard. The work is
    then the text times the number of shards that a document has a part in,
    which no longer grows with the number of documents.

    Texts that are null or shorter than min_chars share nothing. Repeated rows
    count once, equal texts under different ids are members of one group. An
    empty input gives empty results.
    """
    rows, members = _texts(docs, doc_id, text, min_chars)
    recurring = materialize(_recurring(_phrases(rows, min_chars, phrase_chars)))
    shards = -(-recurring.where("key = first").count() // shard_phrases)
    routed = shards > 1 if routed is None else routed
    holders = _holders(rows, members, recurring, shards, shard_phrases, routed)
    if routed:
        holders = materialize(holders)
    path = qualified(docs.sparkSession, scratch_path(docs.sparkSession))
    _passages(holders, min_chars, phrase_chars).repartition("shard").write.partitionBy("shard").parquet(path)
    if routed:  # a shard's texts may be split between tasks, where there are many
        streamed = holders.select("doc", "text", F.explode("shards").alias("shard")).hint("rebalance", F.col("shard")).sortWithinPartitions("shard")
    else:
        streamed = rows.join(members.where("doc <> rep").select("doc", "key"), ["doc", "key"], "left_anti")
    occurrences = materialize(_occurrences(streamed, path, shards, min_chars, phrase_chars))
    # Written, so that its size is known when the joins with the occurrences are planned.
    many = materialize(occurrences.groupBy("phrase").agg(F.count("*").alias("n")).where(F.col("n") > direct_limit).select("phrase"))
    found = materialize(_compare(occurrences.join(many, "phrase", "left_anti").select("phrase", "doc", "pos", "before", "around"), min_chars, phrase_chars).distinct())
    windows = _windows(occurrences.join(many, "phrase").select("phrase", "doc", "pos", "before", "around"), min_chars)
    frequent = windows.groupBy("window").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("window")
    windows = materialize(windows.join(frequent, "window"))
    links = found.where("doc < other").select(F.col("doc").alias("doc_a"), F.col("other").alias("doc_b")).unionByName(_window_links(windows)).distinct()
    spans = found.select("doc", "start", "end").unionByName(windows.select("doc", "start", (F.col("start") + min_chars).alias("end"))).distinct()
    return links, members.select("doc", "rep").distinct(), spans


def linked_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_a, doc_b) of all documents: links between representatives carried
    over to the members of their groups, and the pairs within each group."""
    of_a = members.select(F.col("rep").alias("doc_a"), F.col("doc").alias("_a"))
    of_b = members.select(F.col("rep").alias("doc_b"), F.col("doc").alias("_b"))
    between = links.join(of_a, "doc_a", "left").join(of_b, "doc_b", "left").select(F.coalesce("_a", "doc_a").alias("x"), F.coalesce("_b", "doc_b").alias("y"))
    within = members.select("rep", F.col("doc").alias("x")).join(members.select("rep", F.col("doc").alias("y")), "rep").where("x < y").select("x", "y")
    return between.unionByName(within).where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def shared_amount(docs: DataFrame, doc_id: str, text: str, members: DataFrame, spans: DataFrame, *, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_chars, n_spans, shared_chars, shared_part) of every document:
    how much of it stands in another one. A document whose whole text occurs
    elsewhere is shared entirely, as one span. Repeated rows give one row, of
    null and empty texts nothing is shared (shared_part 0)."""
    from ..operators.intervals import periods_and_gaps

    periods = periods_and_gaps(spans.select("doc", F.col("start").cast("bigint"), F.col("end").cast("bigint")), ["doc"], "start", "end", slice_width=1 << 16)
    merged = periods.where("kind = 'period'").groupBy("doc").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))
    copies = members.select("doc").distinct().withColumn("whole", F.lit(True))
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_chars")).groupBy("doc").agg(F.max("n_chars").alias("n_chars"))
    chars = F.when(F.col("whole"), F.col("n_chars")).otherwise(F.coalesce("chars", F.lit(0))).cast("bigint")
    return own.join(copies, "doc", "left").join(merged, "doc", "left").select(
        F.col("doc").alias(doc_id), "n_chars", F.when(F.col("whole"), 1).otherwise(F.coalesce("n", F.lit(0))).cast("bigint").alias("n_spans"), chars.alias("shared_chars"),
        F.when(F.col("n_chars") > 0, chars / F.col("n_chars")).otherwise(0.0).alias("shared_part"),
    )
