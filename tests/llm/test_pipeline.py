"""The stages on odd and empty tables, each against what it must do to its own input."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tessera.llm import packing, quality
from tessera.llm.common import table

from .test_operators import similar


def plain(df):
    return collections.Counter((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("where", ["odd", "empty", "small"])
def test_stages(spark, request, where):
    root = request.getfixturevalue(where)
    docs = table(spark, root, "documents")
    names = docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, root).persist()
        if k < 4:
            assert out.columns == names and out.dtypes == docs.dtypes, name
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert {r.doc_id for r in out.select("doc_id").collect()} <= ids
        rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        if name == "quality classifier":
            model = quality.fit(quality.written(quality.measured(docs.select("doc_id", "text")), "m"), table(spark, root, "labels"))
            score = lambda t: model.score(np.array([quality.measures(t)]))[0] if model else 0.5
            assert plain(out) == collections.Counter((d, t) for d, t in rows if score(t) >= quality.CUT)
        if name == "n-gram Jaccard join":
            got = plain(out)
            assert {k: n for k, n in got.items() if k[0] is None} == {k: n for k, n in collections.Counter(rows).items() if k[0] is None}
            rows = sorted((d, t) for d, t in rows if d is not None)
            group = list(range(len(rows)))
            for i, j in similar([t for _, t in rows]):
                group = [group[i] if g == group[j] else g for g in group]
            firsts = {g: k for k, g in reversed(list(enumerate(group)))}
            assert sorted(d for d, _ in got.elements() if d is not None) == sorted(rows[k][0] for k in firsts.values())
        if name == "personal data":
            assert out.count() == docs.count()
            assert not out.where(F.col("text").rlike(r"[a-z]@[a-z]+\.[a-z]|\+\d+ \(\d+\)")).count()
        if name == "mixing":
            before, taken = {r.doc_id: r.text or "" for r in docs.collect()}, collections.Counter()
            for r in out.where("doc_id is not null").collect():
                now = re.findall(r"[^\x20\x09-\x0D]+", r.text)
                taken[r.doc_id] += len(now)
                assert now and " ".join(now) in " ".join(re.findall(r"[^\x20\x09-\x0D]+", before[r.doc_id]))
            assert all(n <= 2 * len(before[d].split()) for d, n in taken.items())
        if name == "best-fit packing":
            tokenizer, want = packing.Words(packing.default_tokenizer()).tokenizer, collections.Counter()
            for d, t in rows:
                ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
                want.update((d, k // 2048, zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048))
            assert collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in out.collect()) == want
        docs = out
    assert set(docs.columns) >= {"doc_id", "piece", "sequence_id", "offset"}


def test_clean_documents_stay(spark):
    root = "/root/testdata/sf0.01"
    docs = table(spark, root, "documents")
    good = table(spark, root, "labels").where("quality = 1").select("doc_id")
    kept = cp.keep_quality(spark, docs, root)
    assert kept.join(good, "doc_id").count() >= 0.98 * docs.join(good, "doc_id").count()
