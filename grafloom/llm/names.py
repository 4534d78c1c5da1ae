"""Variant spellings of person and maker names, by a noisy channel."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Titles and forms of address.
TITLES = frozenset("dr prof ing dipl dipling fr frau hr herr mr mrs ms mag med phd sir lady".split())
# Legal forms, without stops and blanks.
LEGAL = frozenset("gmbh co kg ag ltd inc bv srl spa sa se llc plc ohg kgaa oy ab as corp limited incorporated company cokg gmbhcokg gmbhco nv sarl ug ev eg".split())
_UMLAUTS = str.maketrans({"ä": "a", "ö": "o", "ü": "u", "ß": "s", "0": "o", "1": "l"})
_SOUNDS = (("ch", "k"), ("ph", "f"), ("th", "t"), ("v", "f"), ("z", "s"), ("j", "y"), ("c", "k"), ("ll", "l"))
IMPOSSIBLE = -1e6


@lru_cache(maxsize=100_000)
def fold(token: str) -> str:
    """A word in lower case, without accents, digits of a bad scan as letters."""
    t = unicodedata.normalize("NFC", token.lower()).translate(_UMLAUTS)
    t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    return re.sub(r"[^\w-]|_", "", t)


@lru_cache(maxsize=200_000)
def short(folded: str) -> str:
    """Umlauts and sharp s written out are the same as written plainly."""
    return folded.replace("ae", "a").replace("oe", "o").replace("ue", "u").replace("ss", "s")


@lru_cache(maxsize=100_000)
def sound(folded: str) -> str:
    for a, b in _SOUNDS:
        folded = folded.replace(a, b)
    return folded


def within_one_edit(a: str, b: str) -> bool:
    """At most one letter inserted, left out, replaced, or two neighbours swapped."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :]


def distance(a: str, b: str, most: int = 2) -> int:
    """Letters inserted, left out, replaced, or neighbours swapped, to get from
    a to b; most + 1 if it takes more than most."""
    far = most + 1
    if abs(len(a) - len(b)) > most:
        return far
    before: dict[int, int] = {}
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i in range(1, len(a) + 1):
        here: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            best = min(row.get(j, far) + 1, here.get(j - 1, far) + 1)
            if j:
                best = min(best, row.get(j - 1, far) + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    best = min(best, before.get(j - 2, far) + 1)
            here[j] = min(best, far)
        before, row = row, here
    return row.get(len(b), far)


@lru_cache(maxsize=200_000)
def edits(a: str, b: str) -> int:
    """0 if a and b are the same word, else how many edits apart they are (as
    written or with umlauts and sharp s written plainly, whichever is less), up
    to 3 for more than two. Words of three letters or less are the same or not;
    two edits need words of six letters."""
    if a == b or short(a) == short(b):
        return 0
    least = min(len(a), len(b))
    if least < 4:
        return 3
    if within_one_edit(a, b) or within_one_edit(short(a), short(b)):
        return 1
    return min(distance(a, b), distance(short(a), short(b))) if least > 5 else 3


#: What edits in one word weigh: each further one is less likely than the one before.
TYPOS = (0, 1, 3)


def deletes(word: str, most: int = 1) -> set[str]:
    """word and what is left of it without one letter (or up to most), plainly
    and as written: two words at most that many edits apart have one of these in
    common."""
    out = {word, short(word)}
    latest = out
    for n in range(most):
        latest = {w[:i] + w[i + 1 :] for w in latest if len(w) > (3, 4)[min(n, 1)] for i in range(len(w))}
        out = out | latest
    return out


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


@lru_cache(maxsize=50_000)
def readings(name: str) -> tuple[tuple[str, str, float], ...]:
    """(first name, surname, log likelihood) of each way to read a person's
    name, folded; a stop at the end of a first name marks an abbreviation, a
    name of one word has no first name. Empty if there is no name."""
    s = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", name.replace("\xa0", " ")).strip()
    if not re.search(r"[\s,]", s):  # written together
        s = re.sub(r"(?<=[^\W\d_])[._](?=[^\W\d_]{2})", " ", s)
        s = re.sub(r"(?<=[a-zäöüß])(?=[A-ZÄÖÜ][a-zäöüß])", " ", s)
    parts = [[t for t in re.split(r"\s+|(?<=\.)(?=[^\W\d_])", p) if t and fold(t).replace("-", "") not in TITLES] for p in s.split(",", 1)]
    words = [[(fold(t) + ("." if t.endswith(".") or len(fold(t)) == 1 else "")) for t in p if fold(t).strip("-")] for p in parts]
    if len(words) == 2 and words[0] and words[1]:
        first = next((w for w in words[1] if len(w) > 2), words[1][0])
        return ((first, words[0][-1].rstrip("."), 0.0),)
    flat = [w for p in words for w in p]
    if not flat:
        return ()
    if len(flat) == 1:
        return (("", flat[0].rstrip("."), 0.0),)
    long = [w for w in flat if len(w.rstrip(".")) > 1]
    if len(flat) > 2 and len(long) >= 2:  # middle initials tell nothing
        flat = long
    a, z = flat[0], flat[-1]
    if z.endswith("."):
        return ((z, a.rstrip("."), 0.0),) if not a.endswith(".") else ((a, z.rstrip("."), 0.0),)
    if a.endswith("."):
        return ((a, z, 0.0),)
    return ((a, z, -0.2), (z, a, -1.7))


def _kind(first: str) -> int:
    """How much a first name tells: 3 in full, 2 shortened, 1 an initial, 0 none."""
    bare = first.rstrip(".")
    return 0 if not bare else 1 if len(bare) == 1 else 2 if first.endswith(".") else 3


def first_likelihood(variant: str, first: str, known_as: dict[str, float]) -> tuple[float, int]:
    """Log likelihood that first is written as variant, and the weight of the
    typos in it. known_as: other names that stand for first, with their log
    likelihood."""
    own = _first_likelihood(variant, first)
    if own[0] == 0.0 and not own[1] or not known_as or len(variant) < 2 or variant.endswith("."):
        return own
    options = [own]
    for other, likely in known_as.items():
        if other == variant:
            options.append((likely, 0))
        elif len(other) > 3 and edits(variant, other) == 1:
            options.append((likely, 1))
    return max(options, key=lambda o: o[0] - 2.5 * o[1])


@lru_cache(maxsize=200_000)
def _first_likelihood(variant: str, first: str) -> tuple[float, int]:
    v, c = variant.rstrip("."), first.rstrip(".")
    if not v:
        return -2.0 if c else 0.0, 0
    if not c:
        return IMPOSSIBLE, 0
    if short(v) == short(c):
        return 0.0, 0
    if len(v) == 1:
        return (-1.0, 0) if c[0] == v or sound(c)[:1] == sound(v)[:1] else (IMPOSSIBLE, 0)
    if len(c) == 1:
        return IMPOSSIBLE, 0
    if variant.endswith(".") and c.startswith(v):
        return -1.0, 0
    if sound(v) == sound(c):
        return -1.0, 0
    apart = edits(v, c)
    if not variant.endswith(".") and apart < 3:
        return 0.0, TYPOS[apart]
    if len(v) >= 3 and c.startswith(v) and len(c) - len(v) >= 2:
        return -1.5, 0
    if variant.endswith(".") and len(v) >= 3 and within_one_edit(v, c[: len(v)]):
        return -1.0, 1
    return IMPOSSIBLE, 0


@lru_cache(maxsize=200_000)
def surname_likelihood(variant: str, last: str) -> tuple[float, int]:
    apart = edits(variant, last)
    if apart < 3:
        return 0.0, TYPOS[apart]
    if "-" in variant:  # a second surname was added
        for part in variant.split("-"):
            if (apart := edits(part, last)) < 2:
                return -1.5, apart
    return IMPOSSIBLE, 0


def name_likelihood(variant: tuple, candidate: tuple[str, str], known_as: dict[str, float] | None = None) -> tuple[float, int]:
    """Best log likelihood, over the readings of variant, that the candidate
    (first name, surname) is written so; and the weight of the typos this takes."""
    first, last = candidate
    known_as = known_as or {}
    best = (IMPOSSIBLE, 0)
    for v_first, v_last, likely in variant:
        a, b = first_likelihood(v_first, first, known_as), surname_likelihood(v_last, last)
        options = [(likely + a[0] + b[0], a[1] + b[1])]
        if not v_first and len(first) > 2:  # one word: both names written together
            glued = first.rstrip(".") + last
            if (apart := edits(v_last, glued)) < 2:
                options.append((-1.0, apart))
            else:
                for cut in {len(v_last) - len(last) + d for d in (-1, 0, 1)} | {len(v_last) - len(short(last))}:
                    if 2 < cut < len(v_last) and (apart := edits(v_last[cut:], last)) < 2:
                        written = v_last[:cut]
                        likely_first = max(first_likelihood(written, first, known_as), _first_likelihood(first, written))
                        options.append((likely_first[0] - 1.0, likely_first[1] + apart))
        best = max(best, max(options, key=lambda o: o[0] - 2.5 * o[1]), key=lambda o: o[0] - 2.5 * o[1])
    return best


def _readings_of(text: str) -> tuple:
    return tuple((f, s, float(x)) for f, s, x in (r.split("|") for r in text.split("/"))) if text else ()


def _form(name: str | None) -> str:
    return "/".join(f"{f}|{s}|{x}" for f, s, x in readings(name)) if name else ""


def _classes(first: str) -> set[str]:
    """Letters by which first names meet: two names at most two edits apart, or
    that sound alike, have one in common."""
    bare = first.rstrip(".")
    return set(bare[:3]) | set(sound(bare)[:3])


def short_forms(names: DataFrame, *, evidence: float = 5.0, support: int = 2) -> DataFrame:
    """(name, other, likely, is_short): first names that stand for each other,
    as pet and short forms do, learned from how often both occur with the same
    surname in the same block.

    names     block, last, first; repeats count once
    evidence  log likelihood ratio by which a pair must be more frequent than
              namesakes and relatives would be by chance
    support   groups that must have both

    likely is the log of how often name's groups have other beyond chance, but
    not below -1, since most groups show one record of a person; is_short marks the rarer (then the shorter) of the two as the short form.
    """
    once = names.select("block", "last", "first").distinct()
    groups = once.select("block", "last").distinct().count()
    number = once.groupBy("first").agg(F.count("*").alias("m")).where(F.col("m") >= support)
    kept = materialize(once.join(number, "first"))
    both = kept.select("block", "last", F.col("first").alias("a"), F.col("m").alias("ma")).join(kept.select("block", "last", F.col("first").alias("b"), F.col("m").alias("mb")), ["block", "last"])
    both = both.where("a < b").groupBy("a", "b", "ma", "mb").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    chance = F.col("ma") * F.col("mb") / F.lit(float(max(groups, 1)))
    both = both.where((F.col("n") > chance) & (F.col("n") * F.log(F.col("n") / chance) - (F.col("n") - chance) > evidence)).withColumn("beyond", F.col("n") - chance)
    sides = []
    for name, other, m, om in (("a", "b", "ma", "mb"), ("b", "a", "mb", "ma")):
        is_short = (F.col(m) < F.col(om)) | ((F.col(m) == F.col(om)) & (F.length(name) < F.length(other)))
        sides.append(both.select(F.col(name).alias("name"), F.col(other).alias("other"), F.greatest(F.least(F.log(F.col("beyond") / F.col(m)), F.lit(-0.5)), F.lit(-1.0)).alias("likely"), is_short.alias("is_short")))
    return sides[0].unionByName(sides[1])


def person_clusters(
    df: DataFrame, record_id: str, block: str, name: str, *, typo_cost: float = 2.5, novelty: float = 4.0, surname_edits: int = 1, known_forms: dict[str, list[str]] | None = None
) -> DataFrame:
    """Which records of a block (a site) name the same person.

    Spellings are counted for each block; all are candidates for a canonical
    form. The prior of a candidate grows with its count in the block, with how
    common its first name and surname are in all data, and with how complete it
    is. The channel allows typos (letters inserted, left out, replaced or
    swapped; two in a word are less likely than one, more are none), letters
    misread, umlauts written out, initials, shortened and pet names (learned,
    see short_forms), changed order, names written together, added surnames, and
    missing first names. A spelling is attached to the candidate of greater
    prior with the greatest posterior, unless that it is a person of its own
    (novelty, and typos repeated as often as the spelling) is more likely. A
    surname alone comes after every spelling with a first name, however frequent
    it is. Attachments are followed to their end.

    df             one row for each record_id (repeats count once)
    surname_edits  how many edits in a surname are searched, 1 or 2; all that are
                   so near are found. In a first name two are always searched
    known_forms    first name -> other forms, beside those that are learned
    returns        record_id, block, person (the canonical form)

    Candidates meet through words: the distinct surnames of a block are compared
    by what is left of them without a letter (or two), then the spellings that
    have such surnames and first names with a letter among their first three in
    common. Each spelling is compared once however many records have it. Records
    without block or name are left out. Extra columns are ignored.
    """
    rows = df.select(F.col(record_id).alias("id"), F.col(block).alias("block"), F.col(name).alias("name")).where("id is not null and block is not null and name is not null")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["form"] = pdf.pop("name").map(_form)
            yield pdf[pdf["form"] != ""]

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    parsed = materialize(rows.mapInPandas(parse, f"id {types['id']}, block {types['block']}, form string").distinct())
    head = F.split(F.substring_index("form", "/", 1), r"\|")
    counts = parsed.groupBy("block", "form").agg(F.count("*").alias("n")).withColumns({"written": F.get(head, F.lit(0)), "last": F.get(head, F.lit(1))})
    counts = materialize(counts.withColumn("first", F.rtrim("written", F.lit("."))))
    forms_of = short_forms(counts.where("length(written) > 1 and not endswith(written, '.')").select("block", "last", "first"))
    if known_forms:
        given = [(fold(a), fold(b), -1.0, flip) for full, others in known_forms.items() for o in others for a, b, flip in ((full, o, False), (o, full, True))]
        forms_of = forms_of.unionByName(df.sparkSession.createDataFrame(given, forms_of.schema))
    forms_of = forms_of.groupBy(F.col("name").alias("first"), "other").agg(F.max("likely").alias("likely"), F.max("is_short").alias("is_short"))
    forms_of = forms_of.groupBy("first").agg(F.map_from_entries(F.collect_list(F.struct("other", "likely"))).alias("known_as"), F.max("is_short").alias("pet"))
    firsts = counts.where("length(first) > 1").groupBy("first").agg(F.sum("n").alias("n_first"))
    lasts = counts.groupBy("last").agg(F.sum("n").alias("n_last"))
    scored = counts.join(firsts, "first", "left").join(lasts, "last", "left").join(forms_of, "first", "left").select(
        "block", "form", "n", "last", F.coalesce("n_first", F.lit(1)).alias("nf"), F.coalesce("n_last", F.lit(1)).alias("nl"), "known_as", F.coalesce("pet", F.lit(False)).alias("pet"))

    def priors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            readings_of = [_readings_of(form) for form in pdf["form"]]
            kinds = [_kind(r[0][0]) for r in readings_of]
            pdf["prior"] = [math.log(n) + 0.5 * math.log(a) + 0.5 * math.log(b) - (0, 4, 8, 12)[3 - k] - 1.5 * pet - 0.1 * (len(r) > 1) for n, a, b, k, r, pet in zip(pdf["n"], pdf["nf"], pdf["nl"], kinds, readings_of, pdf["pet"])]
            pdf["words"] = [sorted({w for _, last, _ in r for w in (last, *(p for p in last.split("-") if len(p) > 2))}) for r in readings_of]
            # One word may be both names written together: any ending may be the surname.
            pdf["endings"] = [sorted({w[i:] for _, last, _ in r for w in (last, short(last)) for i in range(3, len(w) - 2)}) if not r[0][0] else [] for r in readings_of]
            pdf["as_variant"] = [sorted(set().union(*(_classes(first) or {"*"} for first, _, _ in r))) for r in readings_of]
            pdf["as_candidate"] = [sorted({"*"} | _classes(r[0][0]).union(*map(_classes, known or {}))) for r, known in zip(readings_of, (dict(k) if k is not None else None for k in pdf["known_as"]))]
            yield pdf[["block", "form", "n", "last", "known_as", "prior", "words", "endings", "as_variant", "as_candidate"]]

    lists = ", ".join(f"{c} array<string>" for c in ("words", "endings", "as_variant", "as_candidate"))
    forms = scored.mapInPandas(priors, f"block {types['block']}, form string, n bigint, last string, known_as map<string,double>, prior double, {lists}")
    forms = materialize(forms.withColumns({"fid": F.xxhash64("block", "form"), "named": ~F.startswith("form", F.lit("|"))}))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [sorted(_key(f"{b}|{k}") for k in deletes(w, most)) for b, w, most in zip(pdf["block"], pdf["word"], pdf["most"])]
            yield pdf[["wid"]].assign(keys=keys)

    def word_keys(words: DataFrame, wid: str) -> DataFrame:
        keyed = words.groupBy("block", "word").agg(F.max("most").alias("most")).select("block", "word", "most", F.xxhash64("block", "word").alias("wid"))
        return keyed.mapInPandas(cut, "wid bigint, keys array<bigint>").select(F.col("wid").alias(wid), F.explode("keys").alias("key"))

    words = forms.select("block", F.explode("words").alias("word"), F.lit(surname_edits).alias("most")).unionByName(forms.select("block", F.explode("endings").alias("word"), F.lit(1).alias("most")))
    surnames = forms.select("block", F.col("last").alias("word"), F.lit(surname_edits).alias("most"))
    alike = word_keys(words, "wv").join(word_keys(surnames, "wc"), "key").select("wv", "wc").distinct()
    # A missing first name can only stand for a fuller form or another surname alone.
    here = ["fid", "prior", "named"]
    variants = forms.select("block", *here, F.explode(F.array_union("words", "endings")).alias("w"), "as_variant").select(F.xxhash64("block", "w").alias("wv"), *(F.col(c).alias(f"v{c}") for c in here), F.explode("as_variant").alias("class"))
    candidates = forms.select(F.xxhash64("block", "last").alias("wc"), *(F.col(c).alias(f"c{c}") for c in here), F.explode("as_candidate").alias("class"))
    greater = (F.col("cprior") > F.col("vprior")) | ((F.col("cprior") == F.col("vprior")) & (F.col("cfid") < F.col("vfid")))
    meet = variants.join(alike, "wv").join(candidates, ["wc", "class"]).where((F.col("vfid") != F.col("cfid")) & ((F.col("cnamed") & ~F.col("vnamed")) | ((F.col("cnamed") == F.col("vnamed")) & greater)))
    pairs = meet.select("vfid", "cfid").distinct()
    pairs = pairs.join(forms.select(F.col("fid").alias("vfid"), "block", F.col("form").alias("v"), F.col("n").alias("vn"), F.col("prior").alias("vp")), "vfid")
    pairs = pairs.join(forms.select(F.col("fid").alias("cfid"), F.col("form").alias("c"), F.col("prior").alias("cp"), "known_as"), "cfid")

    def attach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            posterior = []
            for v, n, c, cp, known in zip(pdf["v"], pdf["vn"], pdf["c"], pdf["cp"], pdf["known_as"]):
                first, last, _ = _readings_of(c)[0]
                likely, typos = name_likelihood(_readings_of(v), (first, last), dict(known) if known is not None else None)
                posterior.append(likely - typo_cost * typos * n + cp)
            pdf["posterior"] = posterior
            yield pdf[pdf["posterior"] > pdf["vp"] - novelty][["block", "v", "c", "posterior"]]

    attached = pairs.drop("vfid", "cfid").mapInPandas(attach, f"block {types['block']}, v string, c string, posterior double")
    parent = materialize(attached.groupBy("block", "v").agg(F.max(F.struct("posterior", "c")).getField("c").alias("c")))
    while True:  # first names appear and priors rise along a path, so paths end; each round halves what is left of them
        up = parent.select("block", F.col("v").alias("c"), F.col("c").alias("top"))
        longer = materialize(parent.join(up, ["block", "c"], "left").select("block", "v", F.coalesce("top", "c").alias("c"), F.col("top").isNotNull().alias("moved")))
        moved, parent = longer.where("moved").limit(1).count(), longer.drop("moved")
        if not moved:
            break
    return parsed.join(parent.withColumnRenamed("v", "form"), ["block", "form"], "left").select(F.col("id").alias(record_id), F.col("block").alias(block), F.coalesce("c", "form").alias("person"))


@lru_cache(maxsize=50_000)
def maker_words(name: str) -> tuple[tuple[str, ...], str]:
    """Folded words of a maker's name without legal form, and the legal form."""
    s = re.sub(r"^\s*(?:fa\.|firma)\s+", "", name, flags=re.IGNORECASE)
    s = re.sub(r"(?i)\b([sb])\.\s?([rv])\.\s?(?:([l])\.)?", lambda m: "".join(g for g in m.groups() if g) + " ", s) if re.search(r"(?i)\bs\.\s?r\.\s?l\.|\bb\.\s?v\.", s) else s
    letters = re.match(r"^\s*((?:[^\W\d_]\.\s?){2,})(?:\s|$)", s)
    words = [fold(w) for w in re.split(r"[\s,;()/&+]+|(?<=\.)-|-|(?<=[^\W\d_]{2}\.)(?=[^\W\d_])", s[letters.end(1) :] if letters else s)]
    legal = "".join(w for w in words if w in _LEGAL_FOLDED)
    rest = tuple(w for w in words if w and w not in _LEGAL_FOLDED)
    return ((fold(letters.group(1).replace(" ", "")) + ".", *rest) if letters else rest), legal


_LEGAL_FOLDED = frozenset(map(fold, LEGAL))


def _is_short_for(short: str, word: str) -> bool:
    """short's letters stand in word in their order, from its first letter."""
    if not short or len(short) >= len(word) or short[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


def maker_likelihood(variant: str, maker: str) -> float:
    """Log likelihood that a maker is written as variant."""
    words, legal = maker_words(variant)
    (brand, *others), own_legal = (lambda w: (w[0] or ("",), w[1]))(maker_words(maker))
    score = 0.0 if legal == own_legal else -0.5 if not legal else -2.0
    if not words:
        return IMPOSSIBLE
    if words[0].endswith("."):  # initials
        initials = "".join(w[0] for w in (brand, *others) if w)
        return score - 4.0 if words[0][:-1] == initials and len(words) == 1 else IMPOSSIBLE
    if len(words) == 1 and others:
        glued = brand + "".join(others)
        if (apart := edits(words[0], glued)) < 2:
            return score - 1.0 - 2.5 * apart
    best = IMPOSSIBLE
    for i, w in enumerate(words):
        if (apart := edits(w, brand)) < 2:
            total = score - 2.5 * apart - 0.5 * (i > 0)
            left = list(words[:i] + words[i + 1 :])
            for o in others:
                if not left:
                    total -= 0.5
                    continue
                joined = "".join(left)
                fit = min(left, key=lambda x: (edits(x, o), not _is_short_for(short(x), short(o))))
                if edits(joined, o) == 0 or _is_short_for(short(joined), short(o)):
                    total -= 1.0 * (short(joined) != short(o))
                    left = []
                elif edits(fit, o) < 2 or _is_short_for(short(fit), short(o)):
                    total -= 1.0 * (short(fit) != short(o))
                    left.remove(fit)
            total -= 8.0 * len(left)
            best = max(best, total)
    return best


def maker_matches(df: DataFrame, record_id: str, name: str, makers: DataFrame, maker_id: str, maker_name: str, *, least: float = -7.0) -> DataFrame:
    """The listed maker that a record's hand-typed maker name means.

    Every spelling is scored once, however many records have it. Candidates are
    the listed makers and the first words of spellings that are no listed
    maker's (so that what means an unlisted maker is not forced on a listed
    one); the fewer records have such a word, the less it counts. The posterior adds the log of how often a maker is written
    exactly as listed to the likelihood of typos, abbreviations, initials,
    order, missing or joined words and legal forms.

    df        one row for each record_id (repeats count once)
    returns   record_id, maker_id, exact (written exactly as listed)

    Null and empty names, and names that mean no listed maker, give no row.
    Likelihoods below least are no match.
    """
    rows = df.select(F.col(record_id).alias("id"), F.col(name).alias("name")).where("id is not null and name is not null").distinct()
    counts = rows.groupBy("name").agg(F.count("*").alias("n"))
    listed = makers.select(F.col(maker_id).alias("maker"), F.col(maker_name).alias("listed")).where("maker is not null and listed is not null").groupBy("listed").agg(F.min("maker").alias("maker"))
    listed = listed.join(counts.withColumnRenamed("name", "listed"), "listed", "left").select("maker", "listed", F.coalesce("n", F.lit(0)).alias("m"))

    def keys_of(words: tuple[str, ...], maker: bool) -> list[int]:
        own: set[str] = set()
        if words and words[0].endswith("."):
            return [_key("." + words[0])]
        for w in words[:1] if maker else words:
            own |= deletes(w)
        if maker:
            own |= deletes("".join(words)) | {"." + "".join(w[0] for w in words) + "."}
        return [_key(k) for k in sorted(own)]

    def keyed(column: str, maker: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                words = [maker_words(n)[0] for n in pdf[column]]
                yield pdf.assign(brand=[short(w[0]) if w else None for w in words], words=[[short(x) for x in w] for w in words], keys=[keys_of(w, maker) for w in words])

        return run

    variants = counts.mapInPandas(keyed("name", False), "name string, n bigint, brand string, words array<string>, keys array<bigint>")
    known = listed.mapInPandas(keyed("listed", True), "maker bigint, listed string, m bigint, brand string, words array<string>, keys array<bigint>")
    # First words that no listed maker has, nor is written together as: makers that are not listed.
    common = known.select(F.explode(F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1)))).alias("brand")).union(known.select(F.array_join("words", ""))).distinct()
    unlisted = variants.where("length(brand) > 3").groupBy("brand").agg(F.sum("n").alias("u")).join(known.select("brand").distinct(), "brand", "left_anti").join(common, "brand", "left_anti")
    pairs = variants.select("name", "brand", F.explode("keys").alias("key")).join(known.select("maker", "listed", "m", F.explode("keys").alias("key")), "key").drop("key").distinct()
    pairs = pairs.join(unlisted, "brand", "left")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            likely = [maker_likelihood(v, m) for v, m in zip(pdf["name"], pdf["listed"])]
            pdf["posterior"] = [x + math.log(m + 1) for x, m in zip(likely, pdf["m"])]
            # An unlisted brand written as such competes with a typo of a listed one; a few records may be typos alike.
            rival = pdf["u"].map(lambda u: math.log(u + 1) - 0.5 - 4.5 / u if u == u else -math.inf)
            yield pdf[(pd.Series(likely, index=pdf.index) >= least) & (pdf["posterior"] > rival)][["name", "maker", "listed", "posterior"]]

    scored = pairs.mapInPandas(score, "name string, maker bigint, listed string, posterior double")
    best = scored.groupBy("name").agg(F.max(F.struct("posterior", (-F.col("maker")).alias("k"), "listed")).alias("b")).select("name", (-F.col("b.k")).alias("maker"), (F.col("b.listed") == F.col("name")).alias("exact"))
    return rows.join(best, "name").select(F.col("id").alias(record_id), F.col("maker").alias(maker_id), "exact")
