import shutil
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as CP

from .test_near_dup import classes
from .test_packing import check

SF = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_do_their_work(spark):
    docs = CP.table(spark, SF, "documents")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r.doc_id for r in docs.collect()}
    for name, stage in CP.STAGES[:-1]:
        out = CP.saved(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and out.schema == docs.schema
        rows = out.collect()
        after = {r.doc_id for r in rows}
        assert len(rows) == len(after) and after <= before
        if name == "minhash_dedup":
            texts = [(r.doc_id, r.text) for r in docs.collect()]
            assert after == {i for i, n, c in classes(texts, 5, 80) if i == c}
        else:
            gone = [quality[i] for i in before - after if i in quality]
            left = [quality[i] for i in after if i in quality]
            assert left.count(0) <= 0.02 * max(1, len(left))
            if name == "quality_classifier":  # judged on its input: clean documents stay
                assert gone.count(1) <= 0.01 * len(left)
        docs, before = out, after
    packed = CP.STAGES[-1][1](spark, docs, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    total = Counter()
    for r in packed:
        total[r.doc_id] += r.length
    assert dict(total) == tokens
    check([(r.sequence_id, r.offset, r.length) for r in packed], 1024)


def test_run_equals_the_stages(spark):
    assert entry.queries()["pipeline"] is CP.run
    a = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in CP.run(spark, SF).collect()}
    docs = CP.table(spark, SF, "documents")
    for name, stage in CP.STAGES:
        docs = CP.saved(stage(spark, docs, SF), name)
    assert a == {(r.doc_id, r.start, r.length, r.ids_crc32) for r in docs.collect()}


def test_stages_survive_awkward_rows(spark):
    from .cases import docs as awkward
    from .cases import empty

    for make in (awkward, empty):
        d = make(spark)
        n = d.count()
        for name, stage in CP.STAGES:
            out = CP.saved(stage(spark, d, SF), name)
            if name != "packing":
                assert out.columns == d.columns and out.count() <= n
        kept = CP.STAGES[2][1](spark, d, SF).collect()
        # of the rows without doc_id the one that is a copy goes
        assert [r.text for r in kept if r.doc_id is None] == ["no id at all"] * (n > 0)


def test_entry_without_the_optional_parts(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(CP.__file__).parent
    shutil.copytree(root / "sitesieve", tmp_path / "sitesieve", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not [x for x in q if x.startswith('op')] and len(q) > 100 and e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_oracles(spark):
    from tests.oracle_harness import compare, duck

    con = duck(SF)
    from sitesieve.llm.queries import ORACLE, QUERIES

    for name, sql in ORACLE.items():
        assert compare(spark, name, QUERIES[name], sql, SF, con)["status"] == "match", name
