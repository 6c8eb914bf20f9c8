"""Semantic keys of random tables against a plain version, and statuses of facts."""

import random

from pyspark.sql import functions as F

from factloom.operators import semantics as sm

KIND = "t int, row int, texts array<string>, label_col int, line_col int, value_cols array<int>, statement_type string"


def token(text):
    bare = text.rstrip(":").replace(" ", "")
    return "" if bare.replace(",", "").lstrip("-").replace(".", "", 1).isdigit() else bare[:24]


def head(texts):
    filled = [x for x in texts if x]
    return len(filled) >= 2 and any(w in " ".join(filled) for w in sm.KEYWORDS)


def plain(rows, label_col, line_col, value_cols, kind):
    def label(texts):
        if texts[label_col]:
            return texts[label_col]
        return next((x for i, x in enumerate(texts) if x and i not in value_cols and i != line_col), "")

    def key(header, labels, title=""):
        tokens = [token(x) for x in header if token(x)][:6]
        return f"{kind}{'|t:' + title if title else ''}|h:{','.join(tokens) or 'no_header'}|r:{','.join(labels) or 'no_rows'}"

    whole = key(rows[0], [t for t in (token(label(r)) for r in rows[1:7]) if t][:3])
    out = []
    for at, texts in enumerate(rows):
        since = max([k for k in range(at + 1) if head(rows[k])], default=0)
        title = ""
        for k in range(since - 1, max(-1, since - 3), -1) if since else []:
            if head(rows[k]):
                break
            if token(label(rows[k])):
                title = token(label(rows[k]))
                break
        labels = []
        for k in range(since + 1, min(len(rows), since + 6)):
            if head(rows[k]) or len(labels) == 3:
                break
            labels += [token(label(rows[k]))] if token(label(rows[k])) else []
        out.append((label(texts), since, key(rows[since], labels, title), whole))
    return out


def test_keys_are_those_of_a_plain_version(spark):
    draw = random.Random(8)
    words = ["", "", "项目", "期末数", "货币资金", "存货 合计", "12", "1,000.5", "a very long label that goes on and on:", "本期"]
    tables, rows = {}, []
    for t in range(120):
        width, shape = draw.randrange(2, 5), (draw.randrange(2), draw.choice([None, 1]), [2, 3], draw.choice(["note", "unknown"]))
        tables[t] = [[draw.choice(words) if draw.random() < 0.7 else "" for _ in range(width)] for _ in range(draw.randrange(1, 12))], shape
        rows += [(t, k, texts, shape[0], shape[1], shape[2], shape[3]) for k, texts in enumerate(tables[t][0])]
    got = {(r.t, r.row): (r.label, r.header_row, r.row_key, r.table_key) for r in sm.keyed(spark.createDataFrame(rows, KIND).repartition(3), ["t"]).collect()}
    want = {(t, k): w for t, (grid, shape) in tables.items() for k, w in enumerate(plain(grid, *shape))}
    assert {k: (got.get(k), w) for k, w in want.items() if got.get(k) != w} == {} and len(got) == len(want)


def test_column_keys_and_statuses(spark):
    rows = [(["期末数", "1", "金额："], "x", "amount"), ([], "期末数", "amount"), (["5"], "unknown", "text"), (None, None, "blank")]
    df = spark.createDataFrame(rows, "path array<string>, role string, kind string")
    assert [r[0] for r in df.select(sm.column_key(F.col("path"), F.col("role"), F.col("kind"))).collect()] == ["期末数|金额", "期末数", "text", "blank"]
    cases = [(True, "", "amount", 1.0, "review"), (False, "unresolved", "amount", 1.0, "review"), (False, "repaired", "amount", 1.0, "repaired"), (False, "", "blank", None, "blank"), (False, "cleaned", "text", None, "review"), (False, "", "text", 1.0, "observed"), (False, "", "amount", 1.0, "observed")]
    df = spark.createDataFrame(cases, "s boolean, repair string, kind string, value double, want string")
    assert df.filter(sm.fact_status(F.col("s"), F.col("repair"), F.col("kind"), F.col("value")) != F.col("want")).count() == 0
