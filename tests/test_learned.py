"""The learned classifier, large JSON files, and attachments with their types."""

import io
import json
import re
import sqlite3
from collections import Counter
from math import log

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import classify, learned
from lodestrata.sources import files, json_stream

SF = "/root/testdata/sf0.01"


def plain_scores(train, texts):
    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [Counter(w for t, label in train if label == k for w in words(t)) for k in (0, 1)]
    vocabulary, sums = set(counts[0]) | set(counts[1]), [sum(c.values()) for c in counts]
    n = [max(0.5, sum(label == k for _, label in train)) for k in (0, 1)]
    weight = lambda w: log((counts[1][w] + 1) / (sums[1] + len(vocabulary))) - log((counts[0][w] + 1) / (sums[0] + len(vocabulary)))
    return {key: log(n[1] / n[0]) + sum(weight(w) for w in words(t) if w in vocabulary) for key, t in texts}


def test_scores_equal_a_plain_loop(spark):
    train = [("Good good words Éa", 1), ("bad words", 0), ("good, bad? 7", 1), ("spam spam", 0), ("x", None), ("y", 3), (None, 1), ("", 0)]
    texts = [(1, "good BAD unknown"), (2, ""), (3, None), (4, "spam " * 500), (5, "éa Éa")]
    for some in (train, train[:1], [], [(None, 1)]):
        model = learned.train(spark.createDataFrame(some, "text string, label int"))
        got = {r.ord: r.score for r in learned.score(spark.createDataFrame(texts, "ord long, text string"), model).collect()}
        assert got == pytest.approx(plain_scores([x for x in some if x[1] in (0, 1)], texts))
        assert learned.score(spark.createDataFrame([], "ord long, text string"), model).collect() == []


def test_learned_is_better_than_lists_on_texts_not_seen(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select(F.col("doc_id").alias("ord"), "text", F.col("quality").alias("label"), F.lit("t").alias("origin"))
    held = F.left(F.md5(F.col("ord").cast("string")), F.lit(1)).isin("0", "1", "2")
    learnt = learned.classify_learned(learned.train(rows.where(~held)))
    right = {}
    for name, f in (("lists", classify.classify_rules), ("learned", learnt)):
        found = f(rows.where(held).drop("label"))
        assert found.columns == ["ord", "claim", "domain", "horizon", "importance", "confidence", "target", "status", "source", "evidence", "notes", "fingerprint"] or set(found.columns) >= {"ord", "claim", "horizon", "target"}
        right[name] = found.join(rows.where(held).select("ord", "label"), "ord").select(F.avg(((F.col("horizon") != "drop") == (F.col("label") == 1)).cast("int"))).first()[0]
    assert right["learned"] > right["lists"] + 0.05, right


def test_elements_come_one_after_the_other():
    values = [{"claim": "a [{\"é\\n"}, {"claim": "", "x": [1, [2, {}], None, 1.5e3, True]}, {}, {"claim": "last", "n": -12}]
    whole = [json.dumps(values), json.dumps({"a": 1, "claims": values, "z": {"claims": [9]}}, indent=2), "\ufeff" + json.dumps(values, ensure_ascii=False) + " \n"]
    for text in whole:
        for piece in (1, 2, 5, 1 << 20):
            assert list(json_stream.elements(io.BytesIO(text.encode()), piece=piece)) == values
    assert list(json_stream.elements(io.BytesIO(b'{"claim": "one"}'))) == [{"claim": "one"}] and list(json_stream.elements(io.BytesIO(b"[]"))) == []
    for bad in ("", "[1", "[1,]", "[1 2]", "{} x", '{"claims": [1}', '{"a" 1}', "{1: 2}", "nul", '["' + "x" * 99, "[" + "1," * 50 + "oops," + "1," * 5000 + "1]"):
        with pytest.raises(ValueError):
            list(json_stream.elements(io.BytesIO(bad.encode()), piece=7))


def test_no_more_than_an_element_is_held():
    class Endless(io.RawIOBase):
        given = 0

        def read(self, n):
            self.given += n
            return (b"[" if self.given == n else b"") + b'{"claim": "x"},' * (n // 15)

    stream, text = Endless(), None
    found = json_stream.elements(stream, piece=1500)
    for _ in range(5000):
        next(found)
    assert stream.given < 5000 * 15 + 10_000


def test_large_claims_are_those_of_small_files(spark, tmp_path):
    rows = [{"claim": f"claim {k}", "importance": k % 9, "horizon": "long"} for k in range(3000)]
    (tmp_path / "claims-b.json").write_text(json.dumps(rows))
    (tmp_path / "claims-a.json").write_text(json.dumps({"claims": rows[:5] + [{"claim": " "}]}))
    (tmp_path / "claims-c.json").write_text(json.dumps({"claim": "single"}))
    (tmp_path / "claims-bad.json").write_text(json.dumps(rows)[:-1])
    (tmp_path / "other.json").write_text("[]")
    large, bad = json_stream.read_large_claims(spark, str(tmp_path))
    small, small_bad = files.read_claims(spark, str(tmp_path))
    key = lambda r: (r.ord.file.rpartition("/")[2], r.ord.pos, r.claim, r.importance, r.horizon, r.target)
    assert sorted(map(key, large.collect()), key=str) == sorted(map(key, small.collect()), key=str)
    assert [r.file.rpartition("/")[2] for r in bad.collect()] == ["claims-bad.json"]
    assert files.numbered(large).agg(F.max("ord")).first()[0] == files.numbered(small).agg(F.max("ord")).first()[0]
    assert json_stream.read_large_claims(spark, str(tmp_path / "none"))[0].collect() == []


def test_attachments_keep_their_types(spark, tmp_path):
    path = str(tmp_path / "s.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE session_refs (session_id, kind, n, more)")
        db.executemany("INSERT INTO session_refs VALUES (?, ?, ?, ?)", [("a", "pr", 7, '{"x": {"y": [1, "z"]}}'), ("b", None, 1.5, "{not json"), ("c", "é", "8", b"\x01\xff")])
    rows = files.read_attached_typed(spark, path, "session_refs")
    get = lambda p, t: F.try_variant_get("row", p, t)
    got = {r[0]: tuple(r)[1:] for r in rows.select("session_id", get("$.kind", "string"), F.schema_of_variant(F.variant_get("row", "$.n", "variant")), get("$.more.x.y[1]", "string"), get("$.more", "string")).collect()}
    assert got["a"][:3] == ("pr", "BIGINT", "z") and got["b"][0] is None and got["b"][1].startswith("DECIMAL") and got["b"][3] == "{not json" and got["c"] == ("é", "STRING", None, "01ff")
    assert files.read_attached_typed(spark, path, "none").collect() == []
