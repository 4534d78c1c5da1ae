import random

import pytest

from grafloom.llm.names import deletes, distance, edits, fold, maker_likelihood, maker_matches, name_likelihood, person_clusters, readings, short_forms, within_one_edit


def test_one_edit():
    for a, b in (("abc", "abc"), ("abc", "abd"), ("abc", "acb"), ("abc", "ab"), ("abc", "xabc"), ("", "a")):
        assert within_one_edit(a, b) and within_one_edit(b, a)
    for a, b in (("abc", "cba"), ("abc", "ade"), ("ab", "abcd")):
        assert not within_one_edit(a, b)
    for a, b in (("müller", "muller"), ("gruber", "grbuer"), ("strom", "stroom"), ("hagel", "hage"), ("boeff", "böff")):
        assert deletes(fold(a)) & deletes(fold(b)) and edits(fold(a), fold(b)) < 2
    assert edits("strasse", fold("Straße")) == 0 and edits("pirkfaell", "pirkafell") == 1


def test_graded_edits():
    def plain(a, b):
        d = {(i, j): i + j if not i * j else 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choices("abc", k=rng.randint(0, 7)))
        b = "".join(rng.choices("abc", k=rng.randint(0, 7)))
        assert distance(a, b) == min(3, plain(a, b)), (a, b)
        if len(a) > 5 and len(b) > 5 and plain(a, b) <= 2:
            assert deletes(a, 2) & deletes(b, 2)
    assert (edits("gorwick", "grwikc"), edits("castgrd", "castegard"), edits("gorwick", "gorwitsch")) == (2, 2, 3)


def test_short_forms_are_learned(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        first = rng.choice(["orlando", "mirella", "tasso", "ilvara", "quendo"])
        rows += [("s", f"l{i}", first)] + [("s", f"l{i}", {"orlando": "zebbo", "mirella": "luu"}.get(first, ""))] * (first in ("orlando", "mirella") and rng.random() < 0.3)
        if rng.random() < 0.3:  # a relative
            rows.append(("s", f"l{i}", rng.choice(["orlando", "mirella", "tasso", "ilvara", "quendo"])))
    df = spark.createDataFrame(rows, "block string, last string, first string")
    got = {(r["name"], r["other"]): r for r in short_forms(df).collect()}
    assert set(got) == {("orlando", "zebbo"), ("zebbo", "orlando"), ("mirella", "luu"), ("luu", "mirella")}
    assert got["zebbo", "orlando"]["is_short"] and not got["orlando", "zebbo"]["is_short"] and all(-1 <= r["likely"] <= -0.5 for r in got.values())
    assert short_forms(df.limit(0)).count() == 0


@pytest.mark.parametrize("variant", [
    "Philippa Gorwossen", "GORWOSSEN, Philippa", "Gorwossen Philippa", "P. Gorwossen", "Gorwossen, P.", "Pippa Gorwossen", "PhilippaGorwossen", "philippa.gorwossen", "Pihlippa Gorwossen", "Philippa J. Gorwossen", "Dr. Philippa Gorwossen",
    "Gorwossen", "Phil. Gorwossen", "Fr. Philippa  Gorwossen (night shift)", "Philippa Gorwosen", "Filippa Gorwossen", "PHI11PPA G0RWOSSEN", "Philippa Gorwossen-Meier", "philippagorwossen", "Dipl.-Ing. Philippa Gorwossen",
])
def test_variants(variant):
    likely, typos = name_likelihood(readings(variant), ("philippa", "gorwossen"), {"pippa": -1.0})
    assert likely > -4 and typos <= 2


@pytest.mark.parametrize("other", ["Petra Gorwossen", "Philippa Gorwick", "Philippa Gorwyssyx", "Q. Gorwossen", "Gorwick", ""])
def test_other_people(other):
    likely, _ = name_likelihood(readings(other), ("philippa", "gorwossen"))
    assert likely < -100


def clusters(spark, rows, **more):
    df = spark.createDataFrame([(i, s, n, "x") for i, (s, n) in enumerate(rows)], "rec bigint, site string, name string, form string")
    out = {}
    for r in person_clusters(df, "rec", "site", "name", **more).collect():
        out.setdefault((r["site"], r["person"]), set()).add(r["rec"])
    return sorted(map(sorted, out.values()))


def test_one_site(spark):
    rows = [("s", n) for n in ("Philippa Gorwossen", "Philippa Gorwossen", "P. Gorwossen", "Pihlippa Gorwossen", "Dominik Gorwossen", "Gorwossen Dominik", "Dominik Gorwossyx", "Dominik Gorwossyx", "Ottilie Strom", "Strom")]
    rows += [("t", "Philippa Gorwossen"), (None, "Philippa Gorwossen"), ("t", None), ("t", ""), ("t", "()"), ("t", "  ")]
    assert clusters(spark, rows) == [[0, 1, 2, 3], [4, 5], [6, 7], [8, 9], [10]]


def test_only_variants_and_nothing(spark):
    assert clusters(spark, [("s", "G. Vogt"), ("s", "g. vogt"), ("s", "Bob Ürz"), ("s", "Robert Uerz")], known_forms={"Robert": ["Bob"]}) == [[0, 1], [2, 3]]
    assert clusters(spark, []) == []
    two = [("s", "Anna Gorwick")] * 40 + [("s", "Anna Grwikc"), ("s", "Berta Castegard"), ("s", "Berta Castegard")]
    assert clusters(spark, two, surname_edits=2) == [[*range(41)], [41, 42]]
    df = spark.createDataFrame([(1, "s", "A Bcd")] * 3, "rec bigint, site string, name string")
    assert person_clusters(df, "rec", "site", "name").count() == 1


def test_surnames_alone_are_candidates(spark):
    # no size of the input decides whether surnames alone are compared
    assert clusters(spark, [("s", "Huber"), ("s", "Huber"), ("s", "Hubber")]) == [[0, 1, 2]]
    assert clusters(spark, [("s", "Huber")] * 60 + [("s", "Hubber"), ("t", "Hubber")]) == [[*range(61)], [61]]


def test_surname_alone_outranks_an_initial(spark):
    for n in (50, 60):
        assert clusters(spark, [("s", "Huber")] * n + [("s", "A. Huber")]) == [[*range(n + 1)]]
    # two initials stay two persons, whoever the surname goes to
    sizes = sorted(map(len, clusters(spark, [("s", "Huber")] * 60 + [("s", "A. Huber"), ("s", "B. Huber")])))
    assert sizes == [1, 61]


def test_very_long_and_many(spark):
    rows = [("s", "Anna " + "x" * 3000), ("s", "Anna " + "x" * 3000)] + [("s", f"Person Nr{i:03d}x") for i in range(30)]
    assert len(clusters(spark, rows)) >= 2


MAKERS = [(1, "Brixulo Schweißtechnik AG"), (2, "Castegard Instruments S.r.l."), (3, "Nuvoulo Instruments Ltd"), (4, "Gondtecta Systems GmbH & Co. KG")]


def makers_of(spark, *names):
    df = spark.createDataFrame([(i, n, "clash") for i, n in enumerate(names)], "rec bigint, manufacturer string, name string")
    listed = spark.createDataFrame(MAKERS, "maker_id bigint, name string")
    return {r["rec"]: (r["maker_id"], r["exact"]) for r in maker_matches(df, "rec", "manufacturer", listed, "maker_id", "name").collect()}


def test_makers(spark):
    variants = ["Brixulo Schweißtechnik AG", "BIXULO  SCHWEISSTECHNIK ", "Fa. Brixulo", "Schweißtechnik Brixulo AG", "Brixulo-Schweisstechnik", "Brixuloschweisstechnik", "Brixulo Schweisst. AG", "brixulo schweitßechnik ag", "B.S. AG", "Brixulo (Schweißtechnik)"]
    got = makers_of(spark, *variants)
    assert got == {i: (1, i == 0) for i in range(len(variants))}
    others = ["Pylion Maschinenbau Inc."] * 6 + [None, "", "n/a", "?", "Brixulo Optik AG", "x" * 5000]
    assert makers_of(spark, *others) == {}
    assert makers_of(spark, "Nuvulo Instr. Ltd", "CASTEGNRD INSTRUMENTS", "Gondtecta Systems, GmbH&CoKG") == {0: (3, False), 1: (2, False), 2: (4, False)}
    assert makers_of(spark) == {}


def test_frequent_unlisted_makers_are_not_forced_on_listed_ones(spark):
    assert makers_of(spark, *["Brixulx Schweißtechnik AG"] * 30) == {}
    assert makers_of(spark, "Brixulx Schweißtechnik AG") == {0: (1, False)}


def test_listed_makers_written_together_are_no_rivals(spark):
    glued = ["Brixuloschweisstechnik"] * 30
    assert makers_of(spark, *glued) == {i: (1, False) for i in range(30)}
    assert makers_of(spark, *glued, "Brixulo Schweißtechnik AG") == {i: (1, i == 30) for i in range(31)}


def test_likelihood_orders():
    assert maker_likelihood("Castegard Instruments S.r.l.", "Castegard Instruments S.r.l.") == 0.0
    assert maker_likelihood("Castegard", "Castegard Instruments S.r.l.") > maker_likelihood("Castegrad", "Castegard Instruments S.r.l.") > -7


def test_accuracy_on_made_up_people(spark):
    """Precision and recall of pairs where the persons are known."""
    from itertools import combinations

    rng = random.Random(7)
    # none of these names, nor of their short forms, is in any list
    firsts = ["Orlando", "Mirella", "Tassilko", "Ilvarina", "Quendolf", "Bertrudis", "Sigwalto", "Jadranka", "Ekkimar", "Urbanella", "Fendrich", "Waltrune"]
    pets = {"Orlando": "Zebbo", "Mirella": "Luu", "Tassilko": "Koki", "Ilvarina": "Rinne", "Quendolf": "Dolfi", "Bertrudis": "Trude", "Sigwalto": "Waggi", "Jadranka": "Danka", "Ekkimar": "Mari", "Urbanella": "Nelle"}
    heads, tails = ["Gorw", "Czepp", "Nöthl", "Strömb", "Lerch", "Böff", "Pfrang", "Ilgen", "Quast", "Thalk"], ["ossen", "borough", "wick", "uwald", "mayr", "hagel", "imbeck", "entrop", "ovic", "auer"]

    def typo(w):
        i = rng.randrange(1, len(w) - 1)
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + "x" + w[i + 1 :]])

    def write(f, s):
        return rng.choice([
            lambda: f"{f} {s}", lambda: f"{f} {s}", lambda: f"{s}, {f}", lambda: f"{f.upper()} {s.upper()}", lambda: f"{pets.get(f, f)} {s}", lambda: f"{f[0]}. {s}", lambda: f"{f} {typo(s)}", lambda: f"{typo(f)} {s}",
            lambda: f"{f}{s}", lambda: f"{f} {s.replace('ö', 'oe')}", lambda: f"{s} {f}", lambda: f"Dr. {f} {s} (QS)", lambda: f"{f[:4]}. {s}", lambda: f"{f} M. {s}", lambda: f"{f}.{s}".lower(),
        ])()

    rows, truth = [], {}
    for site in range(40):
        for f, s in {(rng.choice(firsts), rng.choice(heads) + rng.choice(tails)) for _ in range(12)}:
            for _ in range(rng.randint(1, 8)):
                truth.setdefault((site, f, s), []).append(len(rows))
                rows.append((f"s{site}", write(f, s)))
    right = {p for own in truth.values() for p in combinations(own, 2)}
    found = {p for own in clusters(spark, rows) for p in combinations(own, 2)}
    precision, recall = len(right & found) / len(found), len(right & found) / len(right)
    assert precision > 0.97 and recall > 0.95, (precision, recall)
