"""PII in texts with very long runs, and the key on a cluster."""

from types import SimpleNamespace

from tallyspark.llm import common, pii


def test_long_names_and_domains_take_no_stack(spark):
    long = 100_000
    texts = ["Mr A" + "a" * long, "Dr Ab" + "-c" * long + " D" + "e" * long, "to x@" + "a." * long + "com now", "x@" + "1." * long + "1", "Mr Smith and a@b.example.com"]
    made = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key="k")
    got = {r.doc_id: r for r in made.collect()}
    assert [(got[k].n_pii, got[k].pii_kinds) for k in range(5)] == [(1, "person"), (1, "person"), (1, "email"), (0, ""), (2, "email,person")]
    assert got[3].text == texts[3] and got[2].text.startswith("to ") and got[2].text.endswith("com now") and texts[2][3:-4] not in got[2].text


def test_a_cluster_without_a_key_gets_a_random_one():
    def session(master, app, key=None):
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, applicationId=app), conf=SimpleNamespace(get=lambda name, default: key or default))

    one = common.pii_key(session("spark://host:7077", "a"))
    assert len(one) == 64 and one == common.pii_key(session("spark://host:7077", "a")) != common.pii_key(session("spark://host:7077", "b"))
    assert common.pii_key(session("spark://host:7077", "a", "own")) == "own" and common.pii_key(session("local[2]", "a")) == "public test data"
