import re

from factloom.llm.quality_rules import MEASURES, STOP_WORDS, SYMBOLS, quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    places = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in SYMBOLS for c in text), len(lines) - len(set(lines)), len(places))


def test_measures_match_a_plain_count(spark):
    good = "The quick brown fox of the north is in a hurry and that is all. " * 1
    texts = [None, "", " \n ", "a b c", "a b c a b c", "x x x x", "é ñ 日本\n日本 ", "#* a\n\na\na\r\n", good, good * 6, " ".join(f"the {chr(97 + i % 26)}{chr(97 + i // 26)}x of" for i in range(60)), "a\x85b c d", "$ " * 80]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS kept", "7 AS n_words")
    rows = quality(docs).orderBy("doc_id").collect()
    for row, text in zip(rows, texts, strict=True):
        got = tuple(row[m] for m in MEASURES[:5])
        assert got == plain(text), repr(text)
        assert row.n_stop_words == sum(w.lower() in STOP_WORDS for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        assert row.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert not (row.base_failed and row.kept)
    assert rows[10].kept and not rows[12].kept


def test_stop_words_are_a_share_of_all_words(spark):
    # Two different ones were enough once, whatever the length; now they are too few among 200 words, and four aren't.
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(200)]
    texts = [" ".join(["the", "Of", *words[:n]]) for n in (98, 99, 198)] + [" ".join(["the", "Of", "THE", "and", *words[:196]])]
    rows = quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_stop_words, r.n_words, r.kept) for r in rows] == [(2, 100, True), (2, 101, False), (2, 200, False), (4, 200, True)]


def test_no_user_function_and_no_shuffle(spark):
    plan = quality(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert quality(spark.createDataFrame([], "doc_id long, text string")).collect() == []
