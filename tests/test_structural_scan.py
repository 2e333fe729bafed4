"""Structural rules at size: one walk for all patterns, over all cores."""

from lexloom.operators import structural

TEXT = "import os\nx = eval(a)\njwt.encode(p, 'k', algorithm='H')\nos.system(eval(eval(a)))\nif x:\n    f(x, x)\ny = 'eval(a)'\n"


def test_all_patterns_in_one_walk_as_each_alone():
    source = structural.Source(TEXT)
    packs = [p for pack in ("auth", "crypto", "secrets", "deserialization", "subprocess", "tls") for _, _, p in structural.structural_rules(pack, "python")]
    patterns = [structural.compile_pattern(p) for p in [*packs, "eval($X)", "$X", '"$X"', "f($X, $X)", "$F($$$A)", "import os", "$$$X"]]
    found = structural.find_all(source, patterns)
    assert found == [structural.find(source, p) for p in patterns]
    assert [(m.line, source.raw[m.start : m.end]) for m in found[len(packs)]] == [(2, b"eval(a)"), (4, b"eval(eval(a))"), (4, b"eval(a)")]
    assert len(found[-6]) > 10


def test_a_small_file_is_scanned_by_all_cores(spark):
    one = spark.createDataFrame([(i, TEXT) for i in range(40)], "doc_id long, text string").coalesce(1)
    found = structural.scan_structural(one, structural.structural_rules("auth", "python"), "python")
    assert found.rdd.getNumPartitions() >= 4
    assert found.filter("rule_id = 'python-auth-eval'").count() == 120


def test_edits_of_very_many_files_take_no_group_each(spark):
    """Accepted edits across batches, as a loop finds them; no file is a group of its own in Python."""
    import random

    rng = random.Random(1)
    rows = [(rng.randrange(900), s := rng.randrange(50), s + rng.randrange(12), str(i)) for i in range(6000)] + [(7, i, i + 2, "y") for i in range(25_000)]
    want = []
    for doc in {r[0] for r in rows}:
        last = -1
        for r in sorted((r for r in rows if r[0] == doc), key=lambda r: r[1:]):
            if r[1] >= last:
                want.append(r)
                last = r[2]
    found = structural.accepted_edits(spark.createDataFrame(rows, "doc_id long, start long, end long, replacement string"))
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "FlatMapGroupsInArrow" not in found._jdf.queryExecution().toString()
