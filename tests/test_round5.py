import random

from pyspark.sql import functions as F

from pricewright.operators import extract, grid
from pricewright.sources import adapter


def planned(df) -> str:
    """The physical plan as it is before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_code_chunks_in_one_pass(spark):
    """Against brute force; lines are cut without another exchange or any gathering."""
    random.seed(5)
    bits = ["A12", "B7", "€ 10", "oak top", "A12 oak", "x B7", "", "B7 b   c"]
    rows = [(p, i, "   ".join(random.choice(bits) for _ in range(random.randrange(5))) if random.random() < 0.9 else None) for p in range(20) for i in range(6)]
    want = []
    for p, i, t in rows:
        if not any("€" in (u or "") for q, j, u in rows if q == p and i <= j <= i + 2):
            continue
        at = None
        for k, x in enumerate(x for x in (t or "").split("   ") if x.strip()):
            code = next((c for c in ("A12", "B7") if x == c or x.startswith(c + " ")), None)
            if code:
                at = [p, i, k, code, [x[len(code) :].strip()]]
                want.append(at)
            elif at:
                at[4].append(x)
    want = sorted((p, i, k, c, " ".join(x for x in n if x)) for p, i, k, c, n in want)
    found = extract.code_chunks(spark.createDataFrame(rows, "page int, line int, text string"), r"[AB]\d+", "page")
    assert want and sorted(tuple(r) for r in found.select("page", "line", "at", "code", "name").collect()) == want
    assert planned(found).count("Exchange") == 1 and "Aggregate" not in planned(found)


def test_prices_move_once(spark, tmp_path):
    parts = [(1, "b", "oak table", "t", 5), (2, "b", "oak table", "t", 5), (3, "b", "elm", "t", 5)]
    lines = [(1, 1, 1, 1, 2.0, 1234567.4, 0.1, "A"), (2, 1, 1, 1, 2.0, 900.0, 0.1, "A"), (3, 1, 1, 1, 2.0, 900.0, 0.0, "A"), (4, 1, 2, 1, 2.0, 900.0, 0.1, "A"), (5, 7, 3, 2, 2.0, 50.0, 0.1, "R"), (6, 1, 3, 2, 1.0, 50.0, 0.1, "R")]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = adapter.prices(spark, str(tmp_path))
    got = sorted((r.row_ord // 65536 // 8, r.price_eur, r.ambiguous) for r in found.collect())
    assert got == [(1, "1.234.567", True), (2, "900", True), (3, "900", False), (4, "900", False), (5, "+50", True), (6, "Price upon request", True)]
    of_lines = [x for x in planned(found).splitlines() if "Exchange hashpartitioning" in x and "l_partkey" in x]
    assert len(of_lines) == 1 and "Exchange hashpartitioning(brand" not in planned(found)


def grid_rows(spark):
    random.seed(6)
    pick = lambda *x: random.choice(x)
    rows = [(pick("B", None), pick("p", "q"), pick(None, "v"), pick(None, "c"), pick(None, "10x20"), pick(None, "t"), pick(None, "X", "Y"), pick(None, "1", "2"), pick(True, False, False), i) for i in range(300)]
    return rows, spark.createDataFrame(rows, "brand string, product_name string, model_variant string, variant_context string, size string, fabric_tier string, code string, price_eur string, ambiguous boolean, row_ord long")


def test_lost_rows_beside_their_cells(spark):
    """Against brute force with nulls; each row's cell is read off where the row is: one exchange, no join."""
    rows, frame = grid_rows(spark)
    clean = [r for r in rows if not r[8]]
    group = lambda r: (r[0], r[1], r[3], r[2], r[4])
    codes, first = {}, {}
    for r in clean:
        codes.setdefault(group(r), set()).add(r[6] or "")
    cell = lambda r: (*group(r), r[5], (r[6] or "") if len(codes[group(r)]) > 1 else None)
    for r in clean:
        first.setdefault(cell(r), r)
    want = {(r[9], r[7], first[cell(r)][7]) for r in clean if r[7] is not None and first[cell(r)][7] not in (None, r[7])}
    found = grid.lost_rows(frame)
    assert want and {(r.row_ord, r.price_eur, r.shown) for r in found.collect()} == want
    assert planned(found).count("Exchange") == 1 and "Join" not in planned(found)


def test_grid_sorts_a_product_once(spark):
    _, frame = grid_rows(spark)
    found = grid.grouped(frame)
    assert planned(found).count("Exchange") == 1 and planned(found).count("Sort [") == 1
    assert "_hash" in planned(grid.cells(found)).split("Sort [")[1].split(",")[0]


def test_columns_inside_pages(spark):
    """As rows_of_words and split_at_gap, with ties and nulls, and without a window."""
    random.seed(7)
    words = [(p, random.choice([1.0, 2.0, 5.0, 9.0, 20.0]), random.choice([None, 0.0, 10.0, 85.0, 95.0, 200.0]), str(i)) for p in range(40) for i in range(random.randrange(12))]
    w = spark.createDataFrame(words, "page long, top double, left double, text string")
    of = lambda d: sorted((r.page, int(r.text), r.row, r.column) for r in d.collect())
    found = extract.columns_of_words(w)
    assert of(found) == of(extract.split_at_gap(extract.rows_of_words(w))) and found.where(F.col("column") == 1).count() > 0
    assert "Window" not in planned(found)


def shuffled(spark) -> int:
    """Rows that all stages so far wrote for others to read."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_names_in_long_texts_by_brute_force(spark):
    """Names of one letter to 40 at any place of texts of several blocks; what moves follows the names found, not the letters of the texts."""
    from pyspark import StorageLevel

    from pricewright.operators import gates

    random.seed(24)
    letters = "abcd. \U0001f600"
    names = ["a", "\U0001f600b", "xy", "abc"] + ["".join(random.choice("mnop ") for _ in range(k)).strip() + f"{k}." for k in range(1, 41)]
    texts = []
    for i, name in enumerate(names):
        t = [random.choice(letters[1:] if i % 3 else letters) for _ in range(random.choice([0, 5, 255, 256, 257, 271, 272, 700]))]
        for at in (0, 241, 250, 255, 256, 500, len(t)):
            t.insert(min(at, len(t)), random.choice(names) if random.random() < 0.6 else "")
        texts.append(("x" if i % 4 else "y", name, "".join(t) if i % 9 else None, f"K‐{i}" if i % 2 else None))
    d = spark.createDataFrame(texts, "brand string, product_name string, text string, code string")
    want = {(b, p, o) for b, p, t, _ in texts for c, o, _, code in texts if b == c and any(x in (t or "").strip() for x in (o, code and code.lower().replace("‐", "-")) if x)}
    assert {tuple(r) for r in gates.held_names(d).collect()} == want and len(want) > 100

    many = spark.range(400).selectExpr("'x' AS brand", "concat('part ', id, '.') AS product_name", "concat(repeat('words of no name ', 40), sha2(string(id), 512), ' part ', id + 1, '.') AS text").persist(StorageLevel.MEMORY_ONLY)
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        assert gates.held_names(many).where("product_name <> other").count() == 399
        assert shuffled(spark) - before < 12 * 400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        many.unpersist()
