"""The pipeline's stages, one after the other, against brute-force versions of their decisions."""

from __future__ import annotations

import collections
import random

import corpus_pipeline
from tests.llm.test_operators import WORD, base_secrets, brute_components, brute_measures, words


def test_run(spark, tmp_path):
    rng = random.Random(8)
    item = words(rng, 40)
    rows = [(i, words(rng, 60)) for i in range(30)]
    rows += [(40, rows[3][1]), (41, rows[4][1] + " more"), (42, words(rng, 30) + " " + item), (43, "short"), (44, None), (45, words(rng, 30) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'), (46, "again and again " * 30)]
    docs = spark.createDataFrame([(d, t, "en", f"s{d % 4}", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(d, t) for d, t in rows if (m := brute_measures(t or ""))[0] >= 20 and 100 * m[4] <= 30 * m[0]]
    left = [(d, t) for (d, t), c in zip(left, brute_components(left, 5, 80)) if c[3]]
    left = [(d, t) for d, t in left if item not in t]
    assert {d for d, _ in left} == {*range(30), 45}

    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    redacted = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/secret_scan").collect()}
    for d, t in left:
        assert (redacted[d]["text"] == t) == (not base_secrets(t))
        assert redacted[d]["n_chars"] == len(redacted[d]["text"])
    assert redacted[45]["text"].endswith(' [SECRET]"')
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = collections.Counter()
    for r in packed:
        got[r["doc_id"]] += r["n_tokens"]
    assert got == {d: len(WORD.findall(redacted[d]["text"])) for d, _ in left}
