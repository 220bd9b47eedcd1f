"""Secrets in contexts, orders and places that a forest could lose; the forest against its model and held-out findings."""

import hashlib

import regex
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from barline.llm import secret_findings, secrets

FOREST = secrets.Forest([(secrets.FEATURES.index("harmless"), 0.5, 1.0, 0.0)], [])


def token(k):
    return hashlib.sha1(str(k).encode()).hexdigest()


def table(spark, texts, source="web"):
    return spark.createDataFrame([(k, t, source) for k, t in enumerate(texts)], "doc_id long, text string, source string")


def test_harmless_words_count_in_the_value_and_its_name_alone(spark):
    before = ["bob@mail6.example.com token = '", "the latest contest token = '", "http://test.example.org/ password=", "a sample of key: '", "user@test: '", "test_token = '", "example-key='", "tests: '"]
    texts = [f"{b}{token(k)}'" for k, b in enumerate(before)] + ["token = 'my-test-value-12345'", "token = 'latestvalue12345'"]
    found = {r["doc_id"]: r["secret"] for r in secrets.secret_scan(table(spark, texts), FOREST).collect()}
    assert found == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False, 6: False, 7: False, 8: False, 9: True}


def test_the_expressions_equal_the_fitted_model(spark):
    rows = secret_findings.findings(400, seed=5)
    measured = secrets.feature_table(spark, rows)
    model = secrets.fit_model(measured, trees=7, depth=5)
    forest = secrets.as_forest(model)
    both = model.transform(VectorAssembler(inputCols=secrets.FEATURES, outputCol="vector").transform(secrets.feature_table(spark, secret_findings.findings(300, seed=6))))
    pairs = both.select(vector_to_array("probability")[1].alias("p"), forest.score([F.col(f) for f in secrets.FEATURES]).alias("s")).collect()
    assert len({r["p"] for r in pairs}) > 20 and all(abs(r["p"] - r["s"]) < 1e-9 for r in pairs)


def test_precision_and_recall_on_held_out_findings(spark):
    rows = secret_findings.findings(1000, seed=77)
    seen = {r[:3] for r in secret_findings.findings()}
    assert not seen & {r[:3] for r in rows}
    measured = secrets.feature_table(spark, rows).select("label", (secrets.trained_forest(spark).score([F.col(f) for f in secrets.FEATURES]) >= 0.5).alias("told"))
    counts = {(r["label"], r["told"]): r["count"] for r in measured.groupBy("label", "told").count().collect()}
    hit, miss, wrong = (counts.get(k, 0) for k in ((1.0, True), (1.0, False), (0.0, True)))
    assert hit / (hit + miss) > 0.95 and hit / (hit + wrong) > 0.95


def test_secrets_of_many_forms_are_found_and_others_left(spark):
    live = ["AKIA" + "ABCD1234" * 2, f"token = \"{token(1)}\"", f"password={token(2)[:18]}", "db_password: 'hunter2!x'", "gh" + "p_" + "aB3" * 12, "api_key=\"sk-" + "x7Yq" * 8 + "\""]
    fine = [f"see commit {token(3)} there", "card 4279055890764913 ouier", f"checksum = {token(4)}", "the getUserById2Handler ran", "path usr/share/lib-2024 was", "password: example-pass-1"]
    found = secrets.secret_scan(table(spark, [f"some words {t} and more" for t in live + fine])).where("secret").select("doc_id").distinct().collect()
    assert sorted(r["doc_id"] for r in found) == list(range(len(live)))


def test_a_verdict_does_not_depend_on_other_rows(spark):
    mine = f"token = '{token(9)}' and {token(8)}"
    alone = secrets.secret_scan(table(spark, [mine])).collect()
    among = secrets.secret_scan(table(spark, [mine] + [f"see commit {token(k)} there" for k in range(4500)]).coalesce(1)).where("doc_id = 0").collect()
    assert sorted(map(tuple, alone)) == sorted(map(tuple, among)) and sorted(r["secret"] for r in alone) == [False, True]


def test_every_place_of_a_value_is_judged(spark):
    twice = f"👍 test: '{token(1)}' and é token = '{token(1)}' {token(1)}x {token(2)}"
    docs = table(spark, [twice, f"{token(3)} {token(3)}", "no value", "", None, "passwd: 'ab!c.d~e' x"])
    rows = secrets.secret_scan(docs, FOREST).collect()
    texts = {0: twice, 1: f"{token(3)} {token(3)}", 5: "passwd: 'ab!c.d~e' x"}
    assert sorted((r["doc_id"], r["start"], r["value"]) for r in rows) == sorted((d, m.start() + 1, m[0]) for d, t in texts.items() for m in regex.finditer(secrets.CANDIDATE, t))
    assert [r["secret"] for r in sorted(rows, key=lambda r: r["start"]) if r["value"] == token(1)] == [False, True]
    clean = secrets.redact(docs, FOREST).where("doc_id = 0").first()["text"]
    assert token(1) not in clean
