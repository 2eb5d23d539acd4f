"""Credentials and candidates of any length in op11_secrets."""

import collections
import hashlib
import time

import numpy as np
import pytest

from tessera.llm import queries, secret_scan

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def pick(rng, letters, n):
    return "".join(letters[k] for k in rng.integers(0, len(letters), n))


def made(rng, kind):
    if kind == "groups":  # 704 characters
        return "K9Z0" + "".join("-" + pick(rng, "ABCDEF0123456789", 4) for _ in range(140))
    if kind == "base64":
        return "aZ9" + pick(rng, LETTERS + "+/", int(rng.integers(600, 1400)))
    if kind == "slashes":  # as groups, but for punctuation far from the beginning
        return made(rng, "groups")[:400] + "/" + pick(rng, "ABCDEFGHIJKL0123", 303)
    if kind == "short":  # a beginning of groups
        return made(rng, "groups")[:354]
    return "K9Z0-" + pick(rng, "ghijklmnopqrst_012", 700)


@pytest.mark.parametrize("n", [512, 513, 5000, 300_000])
def test_tokens_of_any_length_are_candidates(n):
    token = ("aB3" * n)[:n]
    assert secret_scan.candidates(f"see {token} and ghp_0123456789abc", []) == [(4, 4 + n, token), (9 + n, 26 + n, "ghp_0123456789abc")]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    rows = [(k, f"words {('token', 'api_key')[k % 2]} = {made(rng, ('groups', 'base64')[k // 2 % 2])} and more") for k in range(400)]
    bare = {k: (("groups", "base64", "slashes", "short", "none")[k % 5],) for k in range(400, 600)}
    bare = {k: (kind, made(rng, kind)) for k, (kind,) in bare.items()}
    rows += [(k, f"see {token} there") for k, (_, token) in bare.items()]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bare


def test_long_credentials_teach_their_format_and_long_tokens_are_found(spark, docs, tmp_path):
    df, bare = docs
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.queries()["op11_secrets"](spark, str(tmp_path)).collect()}
    assert len(got) == 600 and all(got[k].n_assign == 1 for k in range(400))
    shares = collections.defaultdict(list)
    for k, (kind, token) in bare.items():
        spans = got[k].spans.split(",") if got[k].spans else []
        assert got[k].base_sha256 == hashlib.sha256(b"").hexdigest() and set(spans) <= {f"format:4:{4 + len(token)}"}
        shares[kind].append(bool(spans))
    assert {kind: np.mean(x) for kind, x in shares.items() if kind != "base64"} == {"groups": 1, "slashes": 0, "short": 0, "none": 0}
    assert np.mean(shares["base64"]) >= 0.9


def test_formats_counted_by_spark_are_those_of_candidates(spark):
    rng = np.random.default_rng(8)
    values = [("a0" + pick(rng, letters, n - 2)) for letters in ("ab0", "AZ09._-", "aZ+/=-_.0") for n in (12, 15, 16, 17, 511, 512, 513, 527, 528, 529, 1039, 1040, 5000)]
    values += ["Q1" + "a" * 600 + mark for mark in secret_scan.MARKS] * 3 + ["pre_fix_" + pick(rng, LETTERS, n) + "1z" for n in (20, 600, 620, 700) * 40]
    rows = spark.createDataFrame([(k, f"token={v}") for k, v in enumerate(values)], "doc_id long, text string")
    model = secret_scan.fit(secret_scan.found(rows))
    plain = collections.Counter(secret_scan.symbols(secret_scan.parts(v), model.prefix["assign"]) for v in values)
    want, got = secret_scan.Automaton(dict(plain)), model.kinds["assign"][0]
    assert model.prefix["assign"]["mixed"] == "pre_fix_" and (got.next, got.total, got.seen) == (want.next, want.total, want.seen)
    assert max(map(len, plain)) == 513  # what reaches the driver is bounded, though no value is left out


def test_very_long_tokens_take_linear_time(spark):
    rows = spark.createDataFrame([(k, f"token={'aZ0/' * 500_000} see {'aZ0/' * 500_000}") for k in range(5)], "doc_id long, text string").repartition(1)
    found = secret_scan.found(rows)
    began = time.monotonic()
    got = [[(x["start"], x["end"]) for x in r.format] for r in secret_scan.scored(found, secret_scan.fit(found)).collect()]
    assert got == [[(2_000_011, 4_000_011)]] * 5 and time.monotonic() - began < 60
