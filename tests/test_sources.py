"""Readers on files in the odd layouts of the exports, and the sinks."""

from __future__ import annotations

import random
from datetime import date

import pytest
from helpers import rows
from pyspark.sql import functions as F

from creditladder.operators.file_order import fill_down_ordered, head_until_null, trim_rows
from creditladder.plans.models import fit_logits, score_all
from creditladder.plans.segments import Segment
from creditladder.sources import exports
from creditladder.sources.lines import ordered_lines, read_export, safe_name, safe_names
from creditladder.sources.sinks import load_models, save_models, write_table


@pytest.fixture
def file(tmp_path):
    def write(name: str, *lines: str) -> str:
        path = tmp_path / name
        path.write_text("\n".join(lines) + "\n")
        return str(path)

    return write


def test_header_names():
    assert safe_name("Loan ID") == "Loan.ID"
    assert safe_name("% Guaranteed") == "X..Guaranteed"
    assert safe_name("1/31/2016") == "X1.31.2016"
    assert safe_names(["a", "a", "b"]) == ["a", "a.1", "b"]


def test_payments(spark, file):
    path = file(
        "disb.csv",
        "Officer,Loan ID,Transaction/ Record Type,Date,Principal Disbursed,Principal Paid",
        'A,12,Payment,1/31/2015,,"1,500.25"',
        "A,abc,NA,bad,10,",
        "",
        "A,13,,2/1/2015,7,x",
    )
    assert rows(exports.load(spark, "payments", path)) == [
        (None, None, None, 10.0, None),
        (12, "Payment", date(2015, 1, 31), None, 1500.25),
        (13, "", date(2015, 2, 1), 7.0, None),
    ]


def test_ratings_keep_file_order(spark, file):
    path = file("r.csv", "Loan ID,Rating Date,Final Risk Score,Final Risk Category", "2,1/5/2015,65,Watch List", "1,1/5/2015,,", "2,1/5/2015,70,Current")
    assert rows(exports.load(spark, "ratings", path), "_ord") == [
        (0, 2, date(2015, 1, 5), 65.0, "Watch List"), (1, 1, date(2015, 1, 5), None, ""), (2, 2, date(2015, 1, 5), 70.0, "Current"),
    ]


def test_file_names_with_blanks_and_missing_headers(spark, file):
    path = file("List of all.csv", "Title", "a,b", "1,2")
    assert rows(read_export(spark, path, skip=1)) == [(0, "1", "2")]
    with pytest.raises(ValueError, match="no header"):
        read_export(spark, path, skip=9)


def test_wide_categories(spark, file):
    path = file("c.csv", "Loan,1/31/2016,2/29/2016", "5,1,NA", "6,,4")
    assert rows(exports.load_wide_categories(spark, path)) == [
        (5, date(2016, 1, 31), 1), (5, date(2016, 2, 29), None), (6, date(2016, 1, 31), None), (6, date(2016, 2, 29), 4),
    ]


BALANCES = (
    "Balance and risk category",
    "Time,LoanID,Balance,Risk",
    "Jan-2016,padding,0,",
    ",padding,0,",
    ",Total LoanID (Rollup),999,",
    ',12,"1,234",Current',
    ",no id,0,",
    "Feb-2016,LoanID (Uncategorized),5,",
    ",12,-3,",
    ",14,,",
    ",12,77,subtotal",
)


def test_balances(spark, file):
    path = file("b.csv", *BALANCES)
    assert rows(exports.load_balances(spark, path)) == [
        (12, date(2016, 1, 31), 1234.0), (12, date(2016, 2, 29), -3.0), (14, date(2016, 2, 29), None),
    ]
    kept = exports.load_balances(spark, path, drop_null_ids=False, month="start")
    assert (None, date(2016, 1, 1), 0.0) in rows(kept) and kept.count() == 4


def test_guarantees(spark, file):
    path = file("g.csv", "List", "Close Date,Loan ID,Bank,% Guaranteed,Notes", '1/1/2016,5,b,85%,"a, b"', "1/1/2016,6,b,,NA", ",,,,", ",9,,10%,total")
    assert rows(exports.load_guarantees(spark, path)) == [(5, 0.85, "a, b"), (6, None, None)]
    assert rows(exports.load_guarantees(spark, path, cut_footer=False)) == [(5, 0.85, "a, b"), (6, None, None), (9, 0.1, "total")]


def test_recoveries_are_strict(spark, file):
    path = file("r.csv", "Loan ID,Internal Recoveries Paid", "1,10", "1,5", "2,x", "2,1")
    assert rows(exports.load_recoveries(spark, path)) == [(1, 15.0), (2, None)]


def test_monthly_ratings(spark, file):
    path = file("m.csv", "RCOppNumber,skip,Lender,RiskDate,RiskCategory", "OPP-1,x,l,2/15/2016,Substandard ", "NA,x,l,3/1/2016,Current")
    assert rows(exports.load_monthly_ratings(spark, path)) == [(None, date(2016, 3, 1), "Current"), ("OPP-1", date(2016, 2, 1), "Substandard")]


@pytest.mark.parametrize("export", sorted(exports.FIELDS))
def test_every_export_reads_its_own_header(spark, file, export):
    fields = exports.FIELDS[export]
    path = file("x.csv", ",".join(src for src, _ in fields.values()), ",".join("1" for _ in fields))
    df = exports.load(spark, export, path)
    assert [c for c in df.columns if c != "_ord"] == list(fields) and df.count() == 1


def test_september_tables(spark, file):
    path = file("s.csv", "LoanID,risk_cat_9_2011,risk_cat_9_2012", "1,0,18", "2,NA,6")
    assert rows(exports.load_september_categories(spark, path)) == [(1, 0, 18), (2, None, 6)]
    path = file("t.csv", "LoanID,balance_0911,other", '1,"1,000.5",q')
    assert rows(exports.load_september_balances(spark, path)) == [(1, 1000.5)]


def test_ordinals_are_dense_over_many_splits(spark, file):
    n = 3000
    path = file("long.csv", "Title", "id,v", *[f"{i},{'x' * (i % 40)}" for i in range(n)])
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        df = read_export(spark, path, skip=1)
        assert df.filter(F.col("_ord") != F.col("id").cast("long")).count() == 0
        assert df.count() == n
        spread = ordered_lines(spark, path).agg(F.min("_ord"), F.max("_ord"), F.count_distinct("_ord")).first()
        assert tuple(spread) == (0, n + 1, n + 2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


def test_fill_in_file_order_matches_a_loop(spark):
    n = 1000
    values = [f"v{i}" if i % 17 == 5 or 300 < i < 310 else None for i in range(n)]
    df = spark.createDataFrame(list(enumerate(values)), "_ord long, v string").repartition(7)
    expected, last = [], None
    for v in values:
        last = v if v is not None else last
        expected.append(last)
    for chunk in (1, 10, 64, 5000):
        got = [r.v for r in fill_down_ordered(df, "v", chunk_rows=chunk).orderBy("_ord").collect()]
        assert got == expected


def test_edges(spark):
    df = spark.range(10).withColumnRenamed("id", "_ord")
    assert rows(trim_rows(df, 2, 1)) == [(i,) for i in range(2, 9)]
    assert rows(trim_rows(df, 0, 0)) == [(i,) for i in range(10)]
    holes = df.withColumn("x", F.when(~F.col("_ord").isin(4, 7), F.col("_ord")))
    assert rows(head_until_null(holes, "x").select("_ord")) == [(i,) for i in range(4)]
    assert head_until_null(df.withColumn("x", F.lit(1)), "x").count() == 10


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_write_table_round_trip(spark, frame, tmp_path, fmt):
    df = frame("a int, b string, c double", [(1, "x", 0.5), (2, None, None), (3, "", 1.0)])
    path = str(tmp_path / "out")
    write_table(df, path, fmt)
    if fmt == "csv":
        back = spark.read.schema("a int, b string, c double").csv(path, header=True, nullValue="NA")
    else:
        back = spark.read.parquet(path)
    assert rows(back) == rows(df)


def test_write_table_by_month(spark, frame, tmp_path):
    df = frame("m date, x int", [(date(2016, 1, 31), i) for i in range(50)] + [(date(2016, 2, 29), 1)])
    path = str(tmp_path / "months")
    write_table(df, path, partition_by=["m"])
    one = spark.read.parquet(path).filter(F.col("m") == F.lit(date(2016, 2, 29)))
    assert one.count() == 1 and "PartitionFilters: [isnotnull(m" in one._jdf.queryExecution().toString()


def test_models_round_trip(spark, frame, tmp_path):
    data = frame("x double, y int", [(i / 10, int((i * 7) % 10 < i / 2)) for i in range(20)])
    segments = {"all": Segment(F.col("y"), ("x",), None, "y"), "none": Segment(F.col("y"), ("x",), F.col("x") > 99, "y")}
    models = fit_logits(data, segments)
    save_models(models, str(tmp_path / "models"), spark)
    back = load_models(str(tmp_path / "models"), spark)
    assert back == models
    assert back["all"].model.coefficients[0] == models["all"].coefficients[0]
    scored = score_all(data, {"p": back["all"], "q": back["none"]})
    assert scored.filter("p is null or q is not null").count() == 0


def test_numbering_survives_other_splits_later(spark, file):
    """The rows are numbered from one stored scan: what the session would do with the file later is no matter."""
    n = 20_000
    path = file("long.csv", "Title", "id,v", *[f"{i},{'x' * 40}" for i in range(n)])
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.leafNodeDefaultParallelism")
    keep = spark.conf.get(names[0])
    spark.conf.set(names[0], "65536")
    spark.conf.set(names[1], "4")
    try:
        df = read_export(spark, path, skip=1)
        spark.conf.set(names[0], "49152")
        spark.conf.set(names[1], "40")
        assert df.filter(F.col("_ord") != F.col("id").cast("long")).count() == 0 and df.count() == n
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "FileScan text" not in plan
    finally:
        spark.conf.set(names[0], keep)
        spark.conf.unset(names[1])


def test_line_breaks_in_notes(spark, file):
    path = file("g.csv", "List", "Close Date,Loan ID,Bank,% Guaranteed,Notes", '1/1/2016,5,b,85%,"two', 'lines, one note"', "1/1/2016,6,b,50%,x", ",,,,", ",9,,10%,total")
    assert rows(exports.load_guarantees(spark, path)) == [(5, 0.85, "two\nlines, one note"), (6, 0.5, "x")]
    with pytest.raises(Exception, match="line_breaks"):
        read_export(spark, path, skip=1).collect()


def test_dates_with_times_and_blanks(spark):
    from creditladder.functions.parsing import parse_date

    texts = ["1/31/2016 0:00", " 1/5/2016", "1/5/2016", "13/1/2016", "x 1/5/2016", "", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", parse_date("t").alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == [date(2016, 1, 31), date(2016, 1, 5), date(2016, 1, 5), None, None, None, None]


# Records with line breaks, found in parallel


@pytest.fixture
def small_splits(spark):
    """Files are cut into splits of a few dozen bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "48", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def csv_text(rows, rng, end="\n"):
    out = []
    for row in rows:
        cells = ['"' + c.replace('"', '""') + '"' if rng.random() < 0.4 or set(c) & set('\n\r,') or c[:1] == '"' else c for c in row]
        out.append(",".join(cells) + end + (end if rng.random() < 0.1 else ""))
    return "".join(out)


def random_rows(rng, n):
    pieces = ["a", "b c", "\n", "\n\n", ",", '"', '""', "5\" pipe", "é", ",,", '"x', 'x"']
    return [[str(i), *["".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 1, 3, 9]))) for _ in range(3)]] for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", range(4))
def test_records_are_those_of_a_csv_reader(spark, tmp_path, small_splits, seed, end):
    rng = random.Random(seed)
    rows = random_rows(rng, 60)
    folder = tmp_path / "notes"
    folder.mkdir()
    (folder / "a.csv").write_bytes(csv_text([["Title \"x"], ["Id", "One", "Two, b", "Three"], *rows[:40]], rng, end).encode())
    (folder / "b.csv").write_bytes(csv_text(rows[40:], rng, end).encode().rstrip())
    scanned = spark.read.text(str(folder), lineSep="\n")
    assert scanned.rdd.getNumPartitions() > 20
    got = [tuple(r) for r in read_export(spark, str(folder), skip=1, line_breaks=True).orderBy("_ord").collect()]
    assert got == [(i, *[c or None for c in row]) for i, row in enumerate(rows)]


def test_records_that_do_not_close_fail(spark, file, small_splits):
    path = file("open.csv", "T\nId,Note\n" + "1,x\n" * 30 + '2,"never closed\n' + "3,y\n" * 30)
    with pytest.raises(Exception, match="does not close"):
        read_export(spark, path, skip=1, line_breaks=True).count()
    # A quote inside a plain field, and one after a closing quote, open nothing.
    path = file("stray.csv", 'T\nId,Note\n1,5" pipe\n2,"a" b"\n3,"x\ny"\n' + "4,z\n" * 30)
    got = read_export(spark, path, skip=1, line_breaks=True).orderBy("_ord").collect()
    assert len(got) == 33 and (got[0].Note, got[2].Note, got[32].Note) == ('5" pipe', "x\ny", "z")


def test_long_records_span_splits(spark, file, small_splits, monkeypatch):
    note = "\n".join(f"line {i}" for i in range(200))
    path = file("long.csv", f'T\nId,Note\n1,"{note}"\n2,"b"\n')
    got = read_export(spark, path, skip=1, line_breaks=True).orderBy("_ord").collect()
    assert [tuple(r) for r in got] == [(0, "1", note), (1, "2", "b")]
    monkeypatch.setattr("creditladder.sources.records.MOST_LINES", 100)
    with pytest.raises(Exception, match="more than 100 lines"):
        read_export(spark, path, skip=1, line_breaks=True).collect()


def test_kept_and_rejected_rows_are_all_rows(spark, file):
    path = file(
        "payments.csv", "Loan ID,Transaction/ Record Type,Date,Principal Disbursed,Principal Paid",
        "1,a,1/2/2016,5,x", "nine,b,1/2/2016,,", ",c,never,1,2", "NA,d,,,", "4,NA,,NA,7", '5,e,1/3/2016,"1,5",8',
    )
    checked = exports.load_checked(spark, "payments", path)
    assert rows(checked.rows.select("_ord", "loan_id", "paid")) == [(0, 1, None), (4, 4, 7.0), (5, 5, 8.0)]
    assert rows(checked.rejected) == [
        (0, "paid", "x", "no number", False), (1, "loan_id", "nine", "no whole number", True), (2, "date", "never", "no date", True),
        (2, "loan_id", None, "missing", True), (3, "loan_id", "NA", "missing", True),
    ]
    dropped = {r._ord for r in checked.rejected.filter("dropped").collect()}
    assert dropped | {r._ord for r in checked.rows.collect()} == set(range(6))
    assert rows(exports.load(spark, "payments", path).filter("loan_id is not null")) == rows(checked.rows.drop("_ord"))
    empty = exports.load_checked(spark, "payments", file("none.csv", "Loan ID,Transaction/ Record Type,Date,Principal Disbursed,Principal Paid"))
    assert empty.rows.count() == 0 and empty.rejected.count() == 0


def test_rejected_balances(spark, file):
    path = file(
        "b.csv", "Title", "Time,LoanID,Balance,Risk", "Jan-2016,pad,0,", ",pad,0,", ",LoanID (Rollup),9,", ",7,12,x", ",no number,3,x", ',8,"1,0x",x', ",Total,1,",
    )
    checked = exports.load_balances_checked(spark, path)
    assert rows(checked.rows.drop("_ord")) == [(date(2016, 1, 31), 7, 12.0), (date(2016, 1, 31), 8, None)]
    assert rows(checked.rejected) == [(4, "loan_id", "no number", "no whole number", True), (5, "balance", "1,0x", "no number", False)]
