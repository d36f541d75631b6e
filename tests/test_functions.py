"""Scalars on literal rows: the traps of the formats."""

from pyspark.sql import functions as F

from groundwork.functions import answers, questions, tables, text


def values(spark, fn, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x")).alias("y")).collect()]


def test_parse_number(spark):
    cells = ["$1,234", "(2,500)", "-$5", "$-5", "(5", "5.5%", "", ",", "2024", "2,024", "1999", "12.50", None]
    assert values(spark, tables.parse_number, cells) == [1234.0, -2500.0, -5.0, None, 5.0, None, None, None, None, None, 1999.0, 12.5, None]


def test_as_year(spark):
    cells = ["2024", " 2025 ", "Jan 26, 2025", "Balance at December 31, 2024", "2031", "2017", "20245", "total", "2,024"]
    assert values(spark, tables.as_year, cells) == [2024, 2025, 2025, 2024, None, None, None, None, None]


def test_canonical_grid(spark):
    mds = [
        "| (in millions) | 2025 | 2024 |\n|---|---|---|\n| Total net sales: | $ 1,500 | 1,400 |\n| Short | 7 |\n| Balance at December 31, 2024 | note | 1 | 2 |",
        "| | 2023 | 2024 |\n|---|---|---|\n| Cost | 5 | 6 |\n| Net sales | 100.0 | 100.0 |",
        "| | 2023 | 2024 | 2023 |\n|---|---|---|---|\n| Cost | 5 | 6 | 7 |",
        "| | 2023 | 2023 | 2024 | 2024 |\n|---|---|---|---|---|\n| Cost | 5 | 6 |",
        "no table",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(mds)), "i int, text string")
    grids = [r["canon"] for r in tables.canonical(df).orderBy("i").collect()]
    first = grids[0]
    assert first["years"] == ["2025", "2024"] and first["unit"] == "millions"
    assert [(r["raw_label"], r["vals"], r["standardized"]) for r in first["rows"]] == [("Total net sales", [1500.0, 1400.0], "TOTAL_REVENUE"), ("note", [1.0, 2.0], None)]
    assert grids[1] is None and grids[2] is None and grids[4] is None and grids[5] is None
    assert grids[3]["years"] == ["2023", "2024"]


def test_caption_shows_last_column(spark):
    md = "| | 2025 | 2024 |\n|---|---|---|\n| Other | 1 | 2 |\n| Net income | 3 | (4,500) |"
    graded = tables.canonical(spark.createDataFrame([(md,)], "text string"))
    got = graded.select(tables.caption(F.col("canon"), F.lit("CO"), F.lit("2025"), F.lit("mda"))).first()[0]
    assert got == "CO FY2025 mda table. Years: 2025, 2024. Net income -4,500 (2024); Other 2 (2024)"


def test_standardize(spark):
    labels = ["Total net sales", "Net income per share", "Gross margin", "INCOME FROM OPERATIONS", "Portion of total net sales that was included in deferred revenue at the start"]
    assert values(spark, tables.standardize_line_item, labels) == ["TOTAL_REVENUE", None, None, "OPERATING_INCOME", None]


def test_questions(spark):
    asked = [
        "What was Apple's revenue in 2024?",
        "Compare MSFT and azure R&D from 2023 to 2025",
        "fiscal 2023 to fiscal 2025 for google",
        "FY2024 net income of nvda",
        "Why did amazon's net income drop in 2031?",
        "What does AAPL say about total sales in 2024?",
        "Describe the risks",
        "cost of revenue of aws and goog in 2023, 2024, 2025 and 2026 with apple, nvidia and msft",
        None,
    ]
    df = questions.understood(spark.createDataFrame(list(enumerate(asked)), "i int, question string"))
    rows = df.orderBy("i").collect()
    got = [(r["companies"], r["years"], r["metrics"], r["route"], len(r["scopes"])) for r in rows]
    assert got[0] == (["AAPL"], ["2024"], ["TOTAL_REVENUE"], "TABLE", 1)
    assert got[1] == (["MSFT"], ["2023", "2024", "2025"], ["RND_EXPENSE"], "TABLE", 3)
    assert got[2] == (["GOOGL"], ["2023", "2025"], [], "TEXT", 2)
    assert got[3] == (["NVDA"], [], ["NET_INCOME"], "TEXT", 1)
    assert got[4] == (["AMZN"], [], ["NET_INCOME"], "HYBRID", 1)
    assert got[5][3] == "TEXT" and got[6] == ([], [], [], "TEXT", 0)
    assert got[7][2] == ["TOTAL_REVENUE", "COST_OF_REVENUE"] and got[7][4] == 12
    assert got[8] == ([], [], [], "TEXT", 0)


def test_query_filters(spark):
    got = values(spark, questions.query_filters, ["r&d spend company=msft year=2024 fiscal_year=2025", "plain question", "a=b c"])
    assert [tuple(r) for r in got] == [("r&d spend", "MSFT", "2025"), ("plain question", None, None), ("c", None, None)]


def test_sections(spark):
    t = "Item 1. Business 4 Item 7. Management 9 " + "x" * 300 + " Item 1. Business text Item 7. Management more"
    df = spark.createDataFrame([(t,), ("nothing here",), ("",)], "t string").withColumn("b", text.find_sections(F.col("t")))
    rows = df.select("b", text.section_at(F.lit(5), F.col("b")).alias("early"), text.section_at(F.lit(10_000), F.col("b")).alias("late"), text.slice_prose(F.col("t"), F.col("b")).alias("p")).collect()
    starts = [b["start"] for b in rows[0]["b"]]
    assert [b["tag"] for b in rows[0]["b"]] == ["business", "mda"] and t[starts[1] :].startswith("Item 7. ")
    assert (rows[0]["early"], rows[0]["late"], rows[1]["late"]) == ("other", "mda", "other")
    assert [p["tag"] for p in rows[0]["p"]] == ["other", "business", "mda"] and "".join(p["segment"] for p in rows[0]["p"]) == t
    assert [p["segment"] for p in rows[1]["p"]] == ["nothing here"]


def test_answers(spark):
    assert values(spark, answers.is_refusal, ["I can't answer that from these filings.", "i CANT answer THAT from these filings", "No.", None]) == [True, True, False, False]
    assert values(spark, answers.cited_numbers, ["a [2] b [1][2] [x] [99999999999999999999]", "", None]) == [[1, 2], [], None]
    assert values(spark, answers.primary_number, ["1,234 and 5,678,901 and 2,345,678", "12", None]) == ["5678901", None, None]
    df = spark.createDataFrame([("It was $1,234,567", "about 1234567 USD"), ("It was 12", "12"), ("1,000", "2,000")], "a string, b string")
    assert [r[0] for r in df.select(answers.numeric_match(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    got = values(spark, answers.parse_relevant, ["AA FY2021 mda; bad; BB  FY2022 risk_factors", None])
    assert [tuple(x) for x in got[0]] == [("AA", "2021", "mda"), ("BB", "2022", "risk_factors")]
    split = spark.createDataFrame([([0, 1, 3], 2), ([], 0)], "n array<bigint>, k int").select(*answers.citation_split(F.col("n"), F.col("k"))).collect()
    assert [list(map(list, r)) for r in split] == [[[1], [0, 3]], [[], []]]


def test_cosine_of_zero(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([3.0, 4.0], [6.0, 8.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(text.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]
