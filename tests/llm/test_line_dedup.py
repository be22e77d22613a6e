import hashlib

from pyspark.sql import functions as F

from dqspark.llm.line_dedup import keep_bitmaps, kept_text, line_dedup

from .helpers import frame, with_clashes

LONG = "This line is long enough to be looked at by the operator"
OTHER = "x" * 40
STRIP = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=40, min_docs=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = [(d, [(x, x.strip(STRIP).translate(lower)) for x in (t or "").split("\n")]) for d, t in rows]
    holders = {}
    for d, lines in keyed:
        for _, k in lines:
            if len(k) >= min_chars:
                holders.setdefault(k, set()).add(d)
    out = []
    for d, lines in keyed:
        kept = []
        for x, k in lines:
            ids = holders.get(k, set())
            largest = max((i for i in ids if i is not None), default=None)
            if len(ids) < min_docs or d == largest:
                kept.append(x)
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


ROWS = [
    *[(i, f"start {i}\n  {LONG.upper()} \t\nend\n{LONG}\n\nlast {i}\n") for i in range(6)],
    *[(i, f"{OTHER}\n{'y' * 39}\n{'É' * 40}") for i in range(10, 15)],
    (20, LONG),
    (20, f"again\n{LONG}"),
    (21, None),
    (22, ""),
    (23, "\n\n"),
    (None, f"{OTHER}\nnull id"),
    (24, "\n".join([LONG] * 3000)),
    (25, f"{LONG} "),
]


def result(df):
    rows = df.select("doc_id", "_ld_n_lines", "_ld_n_dropped", "_ld_text").collect()
    return sorted(map(tuple, rows), key=repr)


def test_against_brute_force(spark):
    assert result(line_dedup(with_clashes(frame(spark, ROWS)))) == sorted(brute(ROWS), key=repr)


def test_thresholds_are_exact(spark):
    four = [(i, LONG) for i in range(4)]
    assert result(line_dedup(frame(spark, four))) == sorted(brute(four), key=repr)
    assert all(r[2] == 0 for r in result(line_dedup(frame(spark, four))))
    five = [(i, "z" * 40) for i in range(5)] + [(i, "z" * 39) for i in range(10, 16)]
    dropped = {r[0] for r in result(line_dedup(frame(spark, five))) if r[2]}
    assert dropped == {0, 1, 2, 3}


def test_empty_table_and_untouched_documents_need_no_bitmap(spark):
    assert line_dedup(frame(spark, [])).count() == 0
    assert keep_bitmaps(frame(spark, [(1, "short"), (2, LONG)])).count() == 0


def test_runs_are_a_keep_bitmap(spark):
    found = keep_bitmaps(frame(spark, ROWS)).filter("doc_id = 0").first()
    assert sum(found["keep_runs"]) == found["n_lines"] and found["n_dropped"] == sum(found["keep_runs"][1::2])
    text = spark.range(1).select(kept_text(F.lit("a\nb\nc\nd"), F.array(F.lit(1), F.lit(2), F.lit(1))).alias("t")).first()["t"]
    assert text == "a\nd"


def test_hash_is_stable(spark):
    row = line_dedup(frame(spark, ROWS)).filter("doc_id = 5").select(F.sha2("_ld_text", 256).alias("h")).first()
    expected = next(t for d, _, _, t in brute(ROWS) if d == 5)
    assert row["h"] == hashlib.sha256(expected.encode()).hexdigest()
