import re

from pyspark.sql import functions as F

from metalint.functions import paths, text
from metalint.operators import formula


def test_formula_tokens_edges(spark):
    cases = {
        "SUM('My ''T'[a]]b])": [("Call", None, "SUM"), ("Qualified", "My 'T", "a]b")],
        "[m] // [no]\n-- [no]\n/* [no] */ \"[no]\"": [("Unqualified", None, "m")],
        "T[x].[Year] + a.[b]": [("Qualified", "T", "x"), ("Name", "a", "a")],
        "T[open": [], "'open": [("Name", "open", "open")], "": [],
        "\"a \"\" [b]\" & [c]": [("Unqualified", None, "c")],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id int, e string")
    got = {i: [] for i in range(len(cases))}
    for r in formula.formula_tokens(df, ["id"], "e").orderBy("id", "pos").collect():
        got[r.id].append((r.ref_kind, r.tbl, r.obj))
    assert list(got.values()) == list(cases.values())


def test_mask_keeps_length_and_lines(spark):
    texts = ['a "b""c" d', '#"x ""y" "z"', "k // c\nl", "p /* q\nr */ s", '"open\nend', "/* open", "a # b / c"]
    want = ['a        d', '#"x ""y"    ', "k     \nl", "p     \n     s", "     \n   ", "       ", "a # b / c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.m for r in df.orderBy("i").select(formula.mask_text(F.col("t")).alias("m")).collect()] == want


def test_long_texts_do_not_overflow(spark):
    long = '"' + "x" * 200_000 + '" ' + "[" + "y" * 100_000 + "] // " + "z" * 100_000
    df = spark.createDataFrame([(1, long)], "i int, t string")
    assert df.select(F.length(formula.mask_text(F.col("t"))).alias("n")).first().n == len(long)
    assert [len(r.obj) for r in formula.formula_tokens(df, ["i"], "t").collect()] == [100_000]


def test_names_in_text_equals_brute_force(spark):
    names = ["Sales", "Sales Data", "a-b", "%", "é", "x.y", "total", "Données 2", "_"]
    texts = ["Sales + 1", 'x #"Sales Data" y', "MySales sales.", "a-b, A-B", "100 % of é", "xx.y x.yz x.y", "TOTAL", "données 2!", "sales_data _", ""]
    t = spark.createDataFrame([(0, i, x) for i, x in enumerate(texts)], "s int, id int, masked string")
    n = spark.createDataFrame([(0, x) for x in names], "s int, name string")
    got = {(r.id, r.name) for r in formula.names_in_text(t, n, ["s"], ["id"]).collect()}
    want = set()
    for i, x in enumerate(texts):
        for name in names:
            quoted = '#"' + name + '"'
            if quoted.lower() in x.lower() or re.search(rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_.])", x, re.I):
                want.add((i, name))
    assert got == want


def test_paths(spark):
    cases = [("a/./b", "a/b"), ("a\\..\\b", "b"), ("../x", None), ("/x", None), ("C:x", None), ("a//b/", "a/b"), (".", None), ("a/b:c", None), ("a/..", None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, p string")
    assert [r.n for r in df.orderBy("i").select(paths.norm_path(F.col("p")).alias("n")).collect()] == [c[1] for c in cases]
    r = df.select(paths.resolve_relative(F.lit("r/s"), F.lit("../../m")).alias("a"), paths.resolve_relative(F.lit("r"), F.lit("../../m")).alias("b")).first()
    assert (r.a, r.b) == ("m", None)


def test_labels(spark):
    df = spark.createDataFrame([("salesAmount_total",), ("__a-_b",), ("=x",), ("ABc",)], "s string")
    got = [(r.h, r.g) for r in df.select(text.humanize(F.col("s")).alias("h"), text.guard_formula(F.col("s")).alias("g")).collect()]
    assert got == [("Sales Amount total", "salesAmount_total"), ("A b", "__a-_b"), ("=x", "'=x"), ("ABc", "ABc")]
    one = spark.range(1)
    r = one.select(text.join_distinct(F.array(F.lit("b"), F.lit("A"), F.lit("a"), F.lit(" "))).alias("j"), text.literal_number(F.lit("12.500D")).alias("n")).first()
    assert (r.j, r.n) == ("A | b", "12.5")


def test_blocks_of_long_texts_come_from_distinct_runs(spark):
    texts = ["a, b. " * 1000, "x--y->z%", "éa𝒳ß .)", "İſK_1", "", "  \n ", "日本, a"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    runs = formula._mark_runs(F.col("t"))
    got = df.orderBy("i").select(F.lower("t").alias("low"), formula._block_words(F.col("t")).alias("w"), runs.alias("r"),
                                 formula._block_marks(runs, 2).alias("two"), formula._block_marks(runs, 1).alias("one")).collect()
    for r in got:
        low = r.low
        assert sorted(r.w) == sorted(set(re.findall(r"[a-z0-9_]+|[^\x00-\x7f]", low)))
        for n, marks in ((1, r.one), (2, r.two)):
            assert sorted(marks) == sorted(set(re.findall(rf"(?s)(?=([^a-z0-9_\x80-\U0010ffff]{{{n}}}))", low)))
    assert len(got[0].r) < 12


def test_names_beside_each_other_and_in_their_own_text(spark):
    names = ["ab", "b a", "x\\Ey", "𝒳", "é", "aa", '"q"']
    texts = ["xab ab", "cab", "ab.", "a b a", "1x\\Ey x\\Ey", "x\\Eyz", "a𝒳b", "É", "aaa aa", "aaa", '#"""q"""', '"q"', "ab_ AB"]
    t = spark.createDataFrame([(0, i, x) for i, x in enumerate(texts)], "s int, id int, masked string")
    n = spark.createDataFrame([(0, x) for x in names], "s int, name string")
    got = {(r.id, r.name) for r in formula.names_in_text(t, n, ["s"], ["id"]).collect()}
    want = {(i, name) for i, x in enumerate(texts) for name in names
            if ('#"' + name.replace('"', '""') + '"').lower() in x.lower() or re.search(rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_.])", x, re.I)}
    assert got == want
