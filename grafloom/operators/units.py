"""Quantities in mixed units, brought to the common unit of their type."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import UNITS, named_units
from ..session import materialize, whole_groups

#: Rows of a device that are decoded at once, about.
SLICE_ROWS = 4_096
#: Shares of smooth steps of the level that are tried.
SMOOTH = (0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.98)
_IMPOSSIBLE = -1e9


def base_name(name: Column) -> Column:
    """A parameter's name without a unit annotation at its end."""
    return F.lower(F.trim(F.regexp_replace(name, r"(?i)\s*(\[[^\]]*\]|\([^)]*\)|\s/\s*\S.*|,\s+\S.*|\s(in|per)\s+\S.*)\s*$", "")))


def moves(share: np.ndarray, switch: float) -> np.ndarray:
    """Log probability of going from each unit to each."""
    return np.log((1 - switch) * np.eye(len(share)) + switch * share[None, :])


def steps(move: np.ndarray, x: np.ndarray, h: np.ndarray, scale: float, smooth: float) -> np.ndarray:
    """(n - 1) x K x K: log score of going from each unit at a row to each at the
    next: the switch, and where the level goes. Either it moves on smoothly (a
    Laplace law of the jump, with share smooth), or it is drawn anew (density h,
    as a log). x: levels under each unit; h: their log densities, and the log
    slopes of the level by the value as written (n x 2 x K)."""
    jump, slope, h = np.abs(x[1:, None, :] - x[:-1, :, None]), h[1:, None, 1, :], h[:, 0, :]
    near = np.log(smooth / (2 * scale)) - np.nan_to_num(jump) / scale
    fresh = np.broadcast_to(math.log(1 - smooth) + h[1:, None, :], jump.shape)
    return move + np.where(np.isnan(x[1:, None, :] + 0 * jump), 0.0, slope + np.where(np.isnan(jump), fresh, np.logaddexp(near, fresh)))


def _emission(allowed: np.ndarray, k: int) -> np.ndarray:
    """0 for the units that a row may be in, impossible for others. allowed is
    a set of bits; none set is all."""
    bits = (allowed[:, None] >> np.arange(k)) & 1
    return np.where((bits > 0) | (allowed == 0)[:, None], 0.0, _IMPOSSIBLE)


def _fixed(allowed: np.ndarray) -> np.ndarray:
    """The unit of rows that can be in but one, else -1."""
    return np.where((allowed > 0) & (allowed & (allowed - 1) == 0), np.log2(np.maximum(allowed, 1)).astype(int), -1)


def _forward(best: np.ndarray, step: np.ndarray, emission: np.ndarray) -> np.ndarray:
    """Best scores at the last row, for each row of best the scores at the first."""
    for s, own in zip(step, emission[1:]):
        best = (best[:, :, None] + s).max(axis=1) + own
    return best


def summarise(x: np.ndarray, h: np.ndarray, allowed: np.ndarray, share: np.ndarray, switch: float, scale: float, smooth: float) -> np.ndarray:
    """Best score of the slice for each unit at its first and each at its last
    row, up to a constant. Between the first and the last row whose unit is
    fixed nothing depends on the ends, so that only what lies outside counts."""
    k = len(share)
    e, move, fixed = _emission(allowed, k), moves(share, switch), np.flatnonzero(_fixed(allowed) >= 0)
    from_each = np.where(np.eye(k) > 0, e[0][:, None], 2 * _IMPOSSIBLE)
    if not len(fixed):
        return _forward(from_each, steps(move, x, h, scale, smooth), e)
    first, last = fixed[0], fixed[-1]
    head = _forward(from_each, steps(move, x[: first + 1], h[: first + 1], scale, smooth), e[: first + 1])[:, _fixed(allowed)[first]]
    tail = _forward(e[last][None], steps(move, x[last:], h[last:], scale, smooth), e[last:])[0]
    return head[:, None] + tail[None, :]


def decode(x: np.ndarray, h: np.ndarray, allowed: np.ndarray, share: np.ndarray, switch: float, scale: float, smooth: float, first: int | None = None, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(units, confidence) of the rows: Viterbi's path, its ends fixed if given,
    and the posterior probability of each row's unit on it. Rows whose unit is
    fixed cut the sequence into parts that do not depend on each other."""
    k, move = len(share), moves(share, switch)
    path, sure = _fixed(allowed), np.ones(len(allowed))
    open_rows = np.diff(np.concatenate([[0], (path < 0).astype(int), [0]]))
    e = _emission(allowed, k)
    for row, state in ((0, first), (-1, last)):
        if state is not None:
            e[row] = np.where(np.arange(k) == state, 0.0, _IMPOSSIBLE)
    for a, b in zip(np.flatnonzero(open_rows == 1), np.flatnonzero(open_rows == -1)):
        lo, hi = max(a - 1, 0), min(b + 1, len(path))
        step = steps(move, x[lo:hi], h[lo:hi], scale, smooth)
        start = np.log(share) + np.where(np.isnan(x[0]), 0.0, h[0].sum(axis=0)) if a == 0 else np.where(np.arange(k) == path[a - 1], 0.0, _IMPOSSIBLE)
        best, alpha, back = [start + e[lo]], [start + e[lo]], []
        for s, own in zip(step, e[lo + 1 : hi]):
            ways = best[-1][:, None] + s
            back.append(ways.argmax(axis=0))
            best.append(ways.max(axis=0) + own)
            alpha.append(np.logaddexp.reduce(alpha[-1][:, None] + s, axis=0) + own)
        if b < len(path):
            best[-1] = np.where(np.arange(k) == path[b], best[-1], _IMPOSSIBLE)
        beta = [np.zeros(k) if b == len(path) else np.where(np.arange(k) == path[b], 0.0, _IMPOSSIBLE)]
        for s, own in zip(step[::-1], e[lo + 1 : hi][::-1]):
            beta.append(np.logaddexp.reduce(s + (own + beta[-1])[None, :], axis=1))
        state = int(best[-1].argmax())
        for t in range(hi - 1, lo - 1, -1):
            if a <= t < b:
                through = alpha[t - lo] + beta[hi - 1 - t]
                path[t], sure[t] = state, np.exp(through[state] - np.logaddexp.reduce(through))
            if t > lo:
                state = int(back[t - lo - 1][state])
    return path, sure


def runs_of(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of sorted rows, each whole though batches cut it."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        change = np.zeros(len(pdf), dtype=bool)
        for k in keys:
            v = pdf[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
            change[0] |= bool(held) and v[0] != held[-1][k].iat[-1]
        cuts = np.flatnonzero(change)
        for a, b in zip([0, *cuts], [*cuts, len(pdf)]):
            if held and (a > 0 or change[0]) and b > a:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            if b > a:
                held.append(pdf.iloc[a:b])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _unit_table(what) -> Column:
    """An array over the units of a row's type: of names, factors or offsets."""
    return F.create_map(*(x for k, u in UNITS.items() for x in (F.lit(k), F.array(*(F.lit(what(n, p)) for n, p in u.items())))))[F.col("_kind")]


_FACTORS, _OFFSETS, _NAMES = (lambda n, p: p[0]), (lambda n, p: p[1]), (lambda n, p: n)


def _level(value: Column, factor: Column, offset: Column) -> Column:
    """Log of a value in the common unit; temperatures count from absolute zero.
    Null where there is none."""
    common = F.abs((value - offset) * factor + F.when(F.col("_kind") == "temperature", 273.15).otherwise(0.0))
    return F.when(~F.isnan(common) & (common > 0) & (common < float("inf")), F.log(common))


def _bin(level: Column) -> Column:
    """Bin of a level among those of its parameter, between its least and
    greatest level (_lo, _hi); the number of bins grows with its rows (_total)."""
    return F.floor(F.greatest(F.least((level - F.col("_lo")) / F.col("_wide"), F.lit(1e6)), F.lit(-1e6))).cast("int")


def _density(level: Column) -> Column:
    """Log density of a level among the levels of the parameter, smoothed over
    neighbouring bins."""
    at = F.greatest(F.least(_bin(level), F.lit(99)), F.lit(-9))
    near = lambda i: F.coalesce(F.try_element_at("_bins", at + i), F.lit(0))
    n = (near(-1) + 2 * near(0) + near(1)) / 4
    known = F.log((n + 0.1) / (F.col("_total") + 0.1 * F.col("_k")) / F.col("_wide"))
    return F.when(level.isNotNull(), F.coalesce(known, F.lit(-3.0)))


def common_units(
    df: DataFrame, record_id: str, *, device: list[str], kind: str, name: str, unit: str, description: str, source_text: str, value: str, others: list[str], at: str,
    scale: float = 0.1, confidence: float = 0.9, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """All values of a device's parameters in the common unit of their type.

    A row whose unit field or, if that says nothing, whose texts name one unit
    is converted as it stands. Where they name none, or a text names several, a
    hidden Markov model decides, one for each device and parameter, over the
    rows in order of time: the hidden state is the unit. Rows that name one are
    fixed, those that name several are in one of them. From row to row the unit
    stays or switches, then to a unit in proportion to how often the device
    names it; the level (the log of the value in the common unit) moves on
    smoothly, by a Laplace law of the given scale, or is drawn anew from the
    levels of the parameter. How often the unit switches and how often the level
    is smooth is learned from the rows that name their unit. Viterbi's path
    gives the units; a unit that no text names, and whose path is not better
    than the others by the given confidence, stays unknown.

    A device may hold any share of the rows. Its time is cut into slices of
    about slice_rows rows; of these only the rows to be decoded and their
    neighbours go to Python. Each slice is reduced to a K x K table of best
    scores (K units of the type), the tables of a device are chained, and each
    slice is decoded with the states at its ends fixed. The path is that of the
    whole sequence.

    df        kind is the type of the parameter; at orders the rows (timestamp);
              value and others are doubles; of rows with the same record_id the
              earliest counts
    returns   record_id, kind, unit, unit_from ('named'; 'chosen' of several that
              a text names; 'decoded'; null where unknown), confidence, value
              and others, in the common unit

    A missing kind is taken from the kind that rows of the same name (without
    annotation) most often have, else from the unit named. Where no kind is
    found, unit and values are null. Values that are missing or not a number
    are null. Two values in others are a minimum and a maximum, and are
    exchanged where the first exceeds the second. Rows without a time come
    first, ties go by record_id. Extra columns are ignored.
    """
    named = [f"_d{i}" for i in range(len(device))]
    bound = [f"_o{i}" for i in range(len(others))]
    rows = df.select(
        F.col(record_id).alias("_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(device, named)), F.coalesce(base_name(F.col(name)), F.lit("")).alias("_base"), F.col(kind).alias("_kind"),
        F.col(name).alias("_name"), F.col(unit).alias("_unit"), F.col(description).alias("_desc"), F.col(source_text).alias("_text"),
        F.col(value).cast("double").alias("_v"), *(F.col(c).cast("double").alias(n) for c, n in zip(others, bound)), F.col(at).cast("timestamp").alias("_at"),
    )
    # The type that most rows of a name have; counted before any row is moved.
    known = rows.where(F.col("_kind").isin(list(UNITS)) & (F.col("_base") != "")).groupBy("_base", "_kind").count()
    known = known.groupBy("_base").agg(F.max(F.struct("count", "_kind")).getField("_kind").alias("_usual"))
    rows = rows.join(known, "_base", "left").withColumn("_kind", F.when(F.col("_kind").isin(list(UNITS)), F.col("_kind")).otherwise(F.col("_usual"))).drop("_usual")
    texts = ["_unit", "_name", "_desc", "_text"]

    def name_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = {k: {u: i for i, u in enumerate(units)} for k, units in UNITS.items()}
        for pdf in batches:
            kinds = pdf["_kind"].where(pdf["_kind"].notna(), None)
            found = [named_units(u, n, d, t, v, k) for u, n, d, t, v, k in zip(*(pdf[c].where(pdf[c].notna(), None) for c in texts), pdf["_v"], kinds)]
            pdf["_kind"] = [k if isinstance(k, str) else f and f[0] for k, f in zip(kinds, found)]
            pdf["_units"] = [sum(1 << places[f[0]][u] for u in f[1]) if f else 0 for f in found]
            yield pdf.drop(columns=texts)

    kept = [f for f in rows.schema.fields if f.name not in texts]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    lean = rows.mapInPandas(name_units, f"{shape}, _units bigint")
    # Repeats are removed once the texts are gone; of a record its first arrival stays. The result is read several times below.
    first = F.min(F.struct("_at", *(c for c in lean.columns if c not in ("_id", "_at")))).alias("_r")
    rows = materialize(lean.groupBy("_id").agg(first).select("_id", "_r.*"))
    fixed = F.bit_count("_units") == 1
    state = F.log2("_units").cast("int")

    # Only sequences with a row to be decoded need a model.
    who = [*named, "_base", "_kind"]
    sequence = F.xxhash64(*who).alias("_seq")
    about = rows.where("_kind is not null").groupBy(sequence).agg(F.count("*").alias("_n"), F.min("_at").alias("_t0"), F.max("_at").alias("_t1"), F.count_if(~fixed).alias("_open")).where("_open > 0").drop("_open")
    seconds = lambda c: F.unix_micros(c) / 1e6
    part = F.floor((seconds(F.col("_at")) - seconds(F.col("_t0"))) / (seconds(F.col("_t1")) - seconds(F.col("_t0")) + 1) * F.ceil(F.col("_n") / slice_rows))
    lean = rows.where("_kind is not null").select("_id", "_base", "_kind", "_v", "_at", "_units", sequence).join(about, "_seq").withColumn("_slice", F.coalesce(part, F.lit(-1)).cast("bigint")).drop("_n", "_t0", "_t1")
    # The distribution of levels of each parameter, from rows that name their unit.
    own_level = F.when(fixed, _level(F.col("_v"), F.get(_unit_table(_FACTORS), state), F.get(_unit_table(_OFFSETS), state)))
    stated = rows.where(F.col("_kind").isNotNull() & fixed).select("_base", "_kind", own_level.alias("_level")).where("_level is not null")
    spread = stated.groupBy("_base", "_kind").agg(F.min("_level").alias("_lo"), F.max("_level").alias("_hi"), F.count("*").alias("_total"))
    bins = F.least(F.greatest(F.ceil(F.sqrt("_total")), F.lit(4)), F.lit(64))
    spread = spread.withColumn("_k", bins).withColumn("_wide", F.greatest((F.col("_hi") - F.col("_lo")) / F.col("_k"), F.lit(1e-3)))
    levels = stated.join(spread, ["_base", "_kind"]).groupBy("_base", "_kind", F.least(_bin(F.col("_level")), F.col("_k") - 1).cast("int").alias("_bin")).count()
    levels = materialize(levels.groupBy("_base", "_kind").agg(F.map_from_entries(F.collect_list(F.struct("_bin", "count"))).alias("_bins")).join(spread, ["_base", "_kind"]))
    order = Window.partitionBy("_seq", "_slice").orderBy(F.asc_nulls_first("_at"), "_id")
    before = {f"_p{c}": F.lag(c).over(order) for c in ("_units", "_level")}
    after = F.lead("_units").over(order)
    near = lambda c: c.isNull() | (F.bit_count(c) != 1)  # noqa: E731 - at an end of the slice, or beside a row to be decoded
    lined = materialize(lean.withColumn("_level", own_level).withColumns(before | {"_rank": F.row_number().over(order), "_a": after}).withColumn("_keep", ~fixed | near(F.col("_p_units")) | near(F.col("_a"))).drop("_a"))

    # What a sequence's own rows say of switches and of smooth steps.
    pairs = lined.where(fixed & (F.bit_count("_p_units") == 1)).join(levels, ["_base", "_kind"], "left")
    jump = F.abs(F.col("_level") - F.col("_p_level"))
    likely = {s: F.sum(F.log(F.lit(s / (2 * scale)) * F.exp(-jump / scale) + F.lit(1 - s) * F.exp(_density(F.col("_level"))))) for s in SMOOTH}
    smooth = F.array_max(F.array(*(F.struct(F.coalesce(likely[s], F.lit(0.0)).alias("l"), F.lit(s).alias("s")) for s in SMOOTH)))["s"]
    learned = pairs.groupBy("_seq").agg(F.avg((F.col("_units") != F.col("_p_units")).cast("double")).alias("_moved"), F.count("*").alias("_pairs"), smooth.alias("_smooth"))
    most = max(map(len, UNITS.values()))
    shares = lined.groupBy("_seq", "_kind").agg(*(F.count_if(F.col("_units") == 1 << i).cast("double").alias(f"_n{i}") for i in range(most)))
    share = F.slice(F.array(*(F.col(f"_n{i}") + 0.5 for i in range(most))), F.lit(1), F.size(_unit_table(_NAMES)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    shares = shares.select("_seq", F.transform(share, lambda x: x / total(share)).alias("_share"))
    even = total(F.transform("_share", lambda p: p * p))
    moved = (F.coalesce("_moved", F.lit(0.0)) * F.coalesce("_pairs", F.lit(0)) + 0.02) / (F.coalesce("_pairs", F.lit(0)) + 1.0) / (1.0 - even)
    model = shares.join(learned, "_seq", "left").select("_seq", "_share", F.least(F.greatest(moved, F.lit(1e-4)), F.lit(1 - 1e-4)).alias("_switch"), F.coalesce("_smooth", F.lit(0.5)).alias("_smooth"))

    # Levels and their densities under every unit, for the rows that are decoded and their neighbours.
    under = lambda f: F.transform(F.arrays_zip(_unit_table(_FACTORS).alias("f"), _unit_table(_OFFSETS).alias("o")), f)
    x = under(lambda u: _level(F.col("_v"), u["f"], u["o"]))
    slope = lambda u, level: F.log(u["f"]) - level  # noqa: E731 - of the level, by the value as written
    h = F.concat(under(lambda u: _density(_level(F.col("_v"), u["f"], u["o"]))), under(lambda u: slope(u, _level(F.col("_v"), u["f"], u["o"]))))
    chosen = lined.where("_keep").join(levels, ["_base", "_kind"], "left").select("_seq", "_slice", "_rank", "_id", "_units", x.alias("_x"), h.alias("_h")).join(model, "_seq")

    def args(pdf: pd.DataFrame) -> tuple:
        first = pdf.iloc[0]
        xs, hs = (np.array([[np.nan if v is None else v for v in row] for row in pdf[c]], dtype=float) for c in ("_x", "_h"))
        return xs, np.where(np.isnan(hs), 0.0, hs).reshape(len(pdf), 2, -1), pdf["_units"].to_numpy(dtype=np.int64), np.array(first["_share"]), first["_switch"], scale, first["_smooth"]

    numbers = "_share array<double>, _switch double, _smooth double"

    def reduce_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs_of(batches, ["_seq", "_slice"]):
            xs, hs, *_ = got = args(pdf)
            row = pdf.iloc[:1][["_seq", "_slice", "_share", "_switch", "_smooth"]]
            yield row.assign(_best=[summarise(*got).ravel().tolist()], _first=[[*xs[0], *hs[0].ravel()]], _last=[[*xs[-1], *hs[-1].ravel()]])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_slice")
        share, switch, smooth = np.array(pdf["_share"].iat[0]), pdf["_switch"].iat[0], pdf["_smooth"].iat[0]
        k, move = len(share), moves(share, switch)
        best = [np.array(b).reshape(k, k) for b in pdf["_best"]]
        first, last = [[np.array(v, dtype=float).reshape(3, k) for v in pdf[c]] for c in ("_first", "_last")]
        start = np.log(share) + np.where(np.isnan(first[0][0]), 0.0, first[0][1] + first[0][2])
        entered, score, ways = [start], (start[:, None] + best[0]).max(axis=0), []
        for (_, before), (b, after) in pairwise(zip([None, *best[1:]], zip(first, last))):
            options = score[:, None] + steps(move, np.stack([before[1][0], after[0][0]]), np.stack([before[1][1:], after[0][1:]]), scale, smooth)[0]
            ways.append(options.argmax(axis=0))
            entered.append(options.max(axis=0))
            score = (entered[-1][:, None] + b).max(axis=0)
        end, ends = int(score.argmax()), []
        for i in range(len(best) - 1, -1, -1):
            begin = int((entered[i] + best[i][:, end]).argmax())
            ends.append((begin, end))
            end = int(ways[i - 1][begin]) if i else end
        return pdf[["_seq", "_slice"]].assign(_start=[a for a, _ in ends[::-1]], _end=[b for _, b in ends[::-1]])

    def decode_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs_of(batches, ["_seq", "_slice"]):
            path, sure = decode(*args(pdf), first=int(pdf["_start"].iat[0]), last=int(pdf["_end"].iat[0]))
            out = pdf[["_id"]].assign(_state=path, _sure=sure)
            yield out[(_fixed(pdf["_units"].to_numpy(dtype=np.int64)) < 0)]

    def in_order(df: DataFrame) -> DataFrame:
        return whole_groups(df, ["_seq", "_slice"], "_seq", "_slice", "_rank")

    reduced = in_order(chosen).mapInPandas(reduce_slices, f"_seq bigint, _slice bigint, {numbers}, _best array<double>, _first array<double>, _last array<double>")
    ends = reduced.groupBy("_seq").applyInPandas(chain, "_seq bigint, _slice bigint, _start int, _end int")
    id_type = rows.schema["_id"].dataType.simpleString()
    decoded = in_order(chosen.join(ends, ["_seq", "_slice"])).mapInPandas(decode_slices, f"_id {id_type}, _state int, _sure double").dropDuplicates(["_id"])

    plain = rows.where(fixed).withColumns({"_state": state, "_sure": F.lit(1.0)})
    left = rows.where(~fixed & F.col("_kind").isNotNull()).join(decoded, "_id", "left")
    none = rows.where("_kind is null and _units = 0").withColumns({"_state": F.lit(None).cast("int"), "_sure": F.lit(None).cast("double")})
    result = plain.unionByName(left).unionByName(none)
    clear = (F.col("_units") > 0) | (F.col("_sure") >= confidence)
    result = result.withColumn("_state", F.when(clear, F.col("_state")))
    factor, offset = (F.get(_unit_table(t), F.col("_state")) for t in (_FACTORS, _OFFSETS))
    result = result.withColumns({c: F.when(~F.isnan(c), (F.col(c) - offset) * factor) for c in ["_v", *bound]} | {"_unit": F.get(_unit_table(_NAMES), F.col("_state"))})
    if len(bound) == 2:
        low, high = map(F.col, bound)
        turned = low > high
        result = result.withColumns({bound[0]: F.when(turned, high).otherwise(low), bound[1]: F.when(turned, low).otherwise(high)})
    return result.select(
        F.col("_id").alias(record_id), F.col("_kind").alias(kind), F.col("_unit").alias(unit),
        F.when(F.col("_state").isNull(), None).when(fixed, "named").when(F.col("_units") > 0, "chosen").otherwise("decoded").alias("unit_from"), F.col("_sure").alias("confidence"),
        F.col("_v").alias(value), *(F.col(n).alias(c) for c, n in zip(others, bound)),
    )
