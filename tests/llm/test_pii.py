"""Personal data against a plain reading of the contract, and the method on planted contexts."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from waveframe.llm import pii

TEXTS = [
    None, "", "no data here", "mail a.b+c@x-y.example.org, or a@b.c_d@e.f now", "@a.b a@ a@b a@b.c.d@e.f.g",
    "ip 10.0.0.1 and 256.1.1.1 and 1.2.3.4.5.6.7.8 and 1.2.3", "0010.001.0.0 999999999999.1.1.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4111  1111 1111 1111", "4" * 5000, "1 " * 3000, "1." * 2000,
    "+1 (437) 555-0689 and +49 30 1234567 and ++1 2 3 +12345", "tel +1-555-010-9999.", "é€😀 a@b.co 😀 +4912345678901",
    "a" * 20000 + "@b.cc " + "b" * 20000, "x@y.z" * 50,
]


def luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain(text: str) -> list[tuple[int, int, int]]:
    out = []
    for k, (kind, pattern) in enumerate(pii.KINDS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def digest(spans) -> str:
    names = list(pii.KINDS)
    return hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def by_kind(spans) -> list[int]:
    return [sum(k == kind for _, k, _ in spans) for kind in range(len(pii.KINDS))]


def reported(docs) -> dict:
    return {r["doc_id"]: (r["base_sha256"], [r[f"n_{kind}"] for kind in pii.KINDS]) for r in pii.report(docs).collect()}


def test_base_spans_match_plain_patterns(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    assert reported(docs) == {i: (digest(found), by_kind(found)) for i, t in enumerate(TEXTS) for found in [plain(t or "")]}


def test_counts_are_of_each_kind(spark):
    docs = spark.createDataFrame([(1, "a@b.co c@d.co e@f.co"), (2, "ip 10.0.0.1"), (3, "4111 1111 1111 1111; +49 1234 5678, +1 (437) 555-0689")], "doc_id long, text string")
    assert {i: n for i, (_, n) in reported(docs).items()} == {1: [3, 0, 0, 0], 2: [0, 1, 0, 0], 3: [0, 0, 1, 2]}


def test_whole_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    want = {r["doc_id"]: (digest(found), by_kind(found)) for r in docs.collect() for found in [plain(r["text"] or "")]}
    assert reported(docs) == want and any(sum(n) > 1 for _, n in want.values())


def test_context_discovers_unseen_identifiers(spark):
    seeds = [(i, f"word{i} passage then hotline +1 415 555 01{i:02d} thanks") for i in range(8)]
    docs = spark.createDataFrame([*seeds, (50, "reach the hotline 415-555-0177 today"), (51, "total of 4155550177 items")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    assert got[50] == "phone:18:30"
    assert got[51] == ""
    assert all(got[i].startswith("phone:") for i in range(8))


def test_redact_keeps_rows_and_columns(spark):
    rows = [(1, "a a@b.co b", "s", 1), (1, "a a@b.co b", "s", 1), (None, "call +1 415 555 0101", None, 2), (3, None, "x", 3), (4, "", "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copy string, spans int")
    got = pii.redact(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([(1, "a [EMAIL] b", "s", 1), (1, "a [EMAIL] b", "s", 1), (None, "call [PHONE]", None, 2), (3, None, "x", 3), (4, "", "x", 3)], docs.schema).collect()))


@pytest.mark.parametrize("what", ["find", "redact"])
def test_empty(spark, what):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert getattr(pii, what)(docs).count() == 0


def test_no_python_in_plan(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", F.col("text"))
    plan = pii.scanned(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute(rows):
    """doc_id -> all spans of texts, by the same rounds in plain Python."""
    def shape(m):
        n = len(re.sub("[^0-9]", "", m))
        if "@" in m:
            return 0
        if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", m):
            return 1
        if 12 <= n <= 19 and not re.search(r"[+().]", m):
            return 2
        return 3 if pii.LEAST_DIGITS <= n <= 15 else None

    found, total = {}, {}
    for i, text in set(rows):
        base, at = plain(text), 0
        for w in re.split(r"[^\w]|[\d_]", text.lower()):
            total[w] = total.get(w, 0) + 1
        for m in re.finditer(r"(?:(?<![^\s<>\"'=:;,()\[\]]))[^\s@<>\"'=:;,()\[\]]+@[^\s@<>\"'=:;,()\[\]]+|[+(]?[0-9](?:[\x20().-]{0,2}[0-9])+", text, re.ASCII):
            words = re.findall(r"[^\W\d_]+", text[at : m.start()])
            at = m.end()
            if (k := shape(m[0])) is not None:
                seed = any(s < m.end() and e > m.start() for s, _, e in base)
                found.setdefault((i, text), []).append((m.start(), k, m.end(), m[0].lower(), words[-1].lower() if words else "", seed))
    edges = {}
    for spans in found.values():
        for _, k, _, value, word, seed in spans:
            if word:
                n, old = edges.get((word, k, value), (0, False))
                edges[word, k, value] = n + 1, old or seed
    specific = {}
    for word, k in {e[:2] for e in edges}:
        own = [n for e, (n, _) in edges.items() if e[:2] == (word, k)]
        if len(own) >= pii.LEAST_SUPPORT and sum(own) / total[word] >= pii.LEAST_SCORE:
            specific[word, k] = sum(own) / total[word]
    graph = {e: float(seed) for e, (_, seed) in edges.items() if e[:2] in specific}

    def scores(known):
        out = {}
        for p, share in specific.items():
            own = [c for e, c in known.items() if e[:2] == p]
            out[p] = sum(own) / len(own) * share if sum(own) >= pii.LEAST_SUPPORT else 0.0
        return out

    known = graph
    for _ in range(pii.ROUNDS):
        score, kept, seeds = scores(known), {}, set()
        for e in graph:
            kept[e[1:]] = kept.get(e[1:], 1.0) * (1 - min(score[e[:2]], 0.999))
            if graph[e]:
                seeds.add(e[1:])
        known = {e: 1.0 if e[1:] in seeds else 1 - kept[e[1:]] for e in graph}
    accepted = {p for p, s in scores(known).items() if s >= pii.LEAST_SCORE}
    sure = {e[1:] for e, c in known.items() if c >= pii.LEAST_CONFIDENCE}
    return {(i, t): sorted({*plain(t), *((s, k, e) for s, k, e, v, w, seed in found.get((i, t), []) if not seed and (w, k) in accepted and (k, v) in sure)}) for i, t in set(rows)}


def test_all_spans_match_brute_force(spark, sf_small):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    rows += [(10_000 + i, f"write to u{i}@host{i % 3}.com, ext 555-01{i % 10}{i}") for i in range(12)] + [(20_000 + i, f"write to u{i}@localhost now, phone +49 30 12345{i:02d}") for i in range(5)]
    rows += [(30_000 + i, f"phone 030 99887{i:02d} or phone +49 30 99887{i:02d}") for i in range(9)]
    want = brute(rows)
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in found.collect()}
    assert got == {i: spans for (i, _), spans in want.items()}
    assert sum(map(len, want.values())) > sum(len(plain(t)) for _, t in rows)


def test_very_many_spans_of_one_text_and_masks(spark):
    import time

    text = " ".join(f"é a{i}@b.co" for i in range(30_000))
    docs = spark.createDataFrame([(1, text), (2, "ip 10.0.0.1, tel +49 30 1234567x, 4111 1111 1111 1111 end 😀"), (3, None)], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert time.time() - began < 60
    assert got == {1: " ".join(["é [EMAIL]"] * 30_000), 2: "ip [IP], tel [PHONE]x, [CARD] end 😀", 3: None}
