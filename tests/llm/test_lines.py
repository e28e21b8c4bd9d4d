import time

from pyspark.sql import functions as F

from packsift.llm import lines, tables


def test_shared_lines_go_and_positions_hold(spark, make_docs):
    rows = [(i, f"head {i}\nALL RIGHTS\n\n own {i} \nfoot", "en", f"s{i}") for i in range(12)]
    rows += [(20, "ALL RIGHTS", "en", "s0"), (21, None, None, None), (22, "", None, None), (23, "foot\n\nfoot\nfree", None, "s1"), (23, "foot\n\nfoot\nfree", None, "s1")]
    out = {r["doc_id"]: r for r in lines.remove_shared_lines(make_docs(rows, extra=("r1", "gone", "line", "h1"))).collect()}
    assert out[3]["text"] == "head 3\n\n own 3 " and (out[3]["n_lines"], out[3]["n_removed"]) == (5, 2)
    assert out[20]["text"] == "" and out[21]["text"] is None and out[22]["text"] == ""
    assert out[23]["text"] == "\nfree" and out[23]["n_removed"] == 2 and out[23]["r1"] == "own"
    assert lines.remove_shared_lines(make_docs(rows)).count() == len(rows)


def test_copies_of_one_text_are_one_site_and_the_threshold_is_exact(spark, make_docs):
    copies = [(i, "the same page\nwith two lines", None, f"s{i}") for i in range(30)]
    nine = [(100 + i, f"{i}\nnine sites", None, f"t{i}") for i in range(9)]
    ten = [(200 + i, f"{i}\nten sites", None, f"t{i}") for i in range(10)]
    null = [(300 + i, f"x{i}\nnull is a site", None, f"t{i}" if i else None) for i in range(10)]
    out = {r["doc_id"]: r["text"] for r in lines.remove_shared_lines(make_docs(copies + nine + ten + null)).collect()}
    assert out[7] == "the same page\nwith two lines"
    assert out[103] == "3\nnine sites" and out[203] == "3" and out[304] == "x4"


def test_empty_table_and_long_text(spark, make_docs):
    assert lines.remove_shared_lines(make_docs([])).count() == 0
    long = "\n".join(f"line {i}" if i % 2 else "foot" for i in range(20000))
    rows = [(i, f"{i}\nfoot", None, f"s{i}") for i in range(10)] + [(50, long, None, "s0")]
    out = {r["doc_id"]: r for r in lines.remove_shared_lines(make_docs(rows)).collect()}
    assert out[50]["text"] == "\n".join(f"line {i}" for i in range(1, 20000, 2)) and out[50]["n_removed"] == 10000


def test_a_site_that_holds_copies_of_all_texts_hides_no_line(spark, make_docs):
    pages = [(i, f"page {i}\nshared foot", None, f"s{i:02}") for i in range(15)]
    copies = [(100 + i, text, None, "aaa") for i, text, *_ in pages]
    nine = [(200 + i, f"{i}\nnine sites, many texts", None, f"t{i % 9}") for i in range(40)]
    few = [(300 + i, f"{i % 9}\nnine texts, many sites", None, f"u{i}") for i in range(40)]
    mixed = [(400 + i, f"{i % 12}\ntwelve texts, ten sites", None, "aaa" if i < 12 else f"v{i % 9}") for i in range(36)]
    docs = make_docs(pages + copies + nine + few + mixed)
    out = {r["doc_id"]: r["text"] for r in lines.remove_shared_lines(docs).collect()}
    assert all(out[i] == out[100 + i] == f"page {i}" for i in range(15))
    assert out[205] == "5\nnine sites, many texts" and out[305] == "5\nnine texts, many sites"
    assert out[405] == "5" and out[430] == "6"


def test_equal_first_hashes_merge_no_rows(spark, make_docs, monkeypatch):
    rows = [(i, f"head {i}\nfoot", None, f"s{i}") for i in range(12)] + [(20, "rare\nfoot\nother", None, "s1")]
    expected = {r["doc_id"]: r["text"] for r in lines.remove_shared_lines(make_docs(rows)).collect()}
    assert expected[20] == "rare\nother" and expected[3] == "head 3"
    two = tables.two_hashes
    for forced in (0, 1):

        def one_of_two(*values):
            hashes = two(*values)
            hashes[forced] = F.lit(7).cast("long")
            return hashes

        monkeypatch.setattr(lines, "two_hashes", one_of_two)
        monkeypatch.setattr(tables, "two_hashes", one_of_two)
        assert {r["doc_id"]: r["text"] for r in lines.remove_shared_lines(make_docs(rows)).collect()} == expected
    values = spark.range(50).select(F.col("id").cast("string").alias("v"))
    seeded = values.select(F.xxhash64("v", F.lit(1)).alias("x"), two(F.col("v"))[1].alias("y"))
    assert seeded.where("x = y").isEmpty()


def test_many_shared_lines_and_salted_joins(spark, make_docs, monkeypatch):
    rows = [(i, "\n".join(f"line {j}" for j in range(i % 5, 40)) + f"\nown {i}", None, f"s{i}") for i in range(20)]
    expected = {r["doc_id"]: r["text"] for r in lines.remove_shared_lines(make_docs(rows)).collect()}
    monkeypatch.setattr(lines, "MAX_BROADCAST_ROWS", 0)
    assert {r["doc_id"]: r["text"] for r in lines.remove_shared_lines(make_docs(rows)).collect()} == expected
    assert expected[7] == "own 7"


def test_many_removed_lines_of_one_text_take_seconds(spark, make_docs):
    rows = [(i, "\n".join(f"foot {j}" for j in range(20000)) + f"\n{i}", None, f"s{i}") for i in range(10)]
    started = time.perf_counter()
    out = lines.remove_shared_lines(make_docs(rows)).where("doc_id = 3").first()
    assert out["text"] == "3" and out["n_removed"] == 20000 and time.perf_counter() - started < 60
