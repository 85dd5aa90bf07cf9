import subprocess
import sys

import corpus_pipeline
from test_similar import brute

from tableferry.llm import mixing, quality
from tableferry.llm.store import staged, table

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, sample):
    before = sample
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = staged(spark, stage(spark, before, SF), "stage")
        ids, left = ([r["doc_id"] for r in d.select("doc_id").collect()] for d in (before, after))
        if at < 4:
            assert after.columns == sample.columns
        if at == 0:
            scored = quality.classify(spark, before, table(spark, SF, "labels"))
            assert sorted(left) == sorted(r["doc_id"] for r in scored.filter("predicted = 1").collect())
        elif at == 1:
            seen = {}
            for doc_id, text in sorted(before.select("doc_id", "text").collect()):
                seen.setdefault(" ".join(text.split(" ")) if "\t" in text else text, doc_id)
            assert len(left) == len(set(left)) and set(left) <= set(seen.values())
        elif at == 2:
            component = brute([tuple(r) for r in before.select("doc_id", "text").collect()])
            assert sorted(left) == sorted(i for i, (_, c) in component.items() if i == c)
        elif at == 3:
            plan = {r["doc_id"]: r["taken"] for r in mixing.mix(spark, before).collect()}
            words = {}
            for r in after.select("doc_id", mixing.words(after.text).alias("n")).collect():
                words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["n"]
            assert words == {i: n for i, n in plan.items() if n}
        else:
            assert set(left) == set(ids)
        before = after


def test_run_and_registration(spark):
    import __spark_entry__

    assert {f"op{n}_" for n in range(1, 11)} <= {name[: name.index("_") + 1] for name in __spark_entry__.queries() if name.startswith("op")}
    assert __spark_entry__.queries()["pipeline"](spark, SF).count() > 0


def test_the_library_does_without(tmp_path):
    """Without this subpackage the entry points still import and keep the other queries."""
    code = (
        "import sys, importlib.util as u; find = u.find_spec\n"
        "u.find_spec = lambda name, *a: None if name.startswith(('tableferry.llm', 'corpus_pipeline')) else find(name, *a)\n"
        f"sys.path.insert(0, {str(__import__('os').path.dirname(corpus_pipeline.__file__))!r})\n"
        "import __spark_entry__ as e; assert 'upsert_orders' in e.queries() and 'pipeline' not in e.queries()\n"
        "assert not any(n.startswith('tableferry.llm') for n in sys.modules)"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
