"""Registered queries that SQL cannot express, and the pipeline, against brute force on the smallest test tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import language_id, license_scan, lz_fingerprint, queries, token_counts

from .test_edges import brute_lines
from .test_queries import near_classes


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for x in texts]


def check_packing(pieces, ids_of):
    """Every id in one piece, no gap in or between sequences, all full but the last."""
    at = 0
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["sequence_id"] * 2048 + p["offset"] == at and 0 < p["length"] <= 2048 - p["offset"]
        assert any(len(v) == p["doc_tokens"] and zlib.crc32(v[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for v in ids_of[p["doc_id"]])
        at += p["length"]
    return at


def test_op2(spark, sf, docs):
    ids = dict(zip(docs, encoded([r["text"] for r in docs.values()])))
    pieces = queries.op2_pack_windows(spark, sf).collect()
    assert check_packing(pieces, {k: [v] for k, v in ids.items()}) == sum(map(len, ids.values()))


def test_op3(spark, sf, docs):
    patterns = (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "AKIA[A-Z0-9]+", "[0-9a-f]+")
    for r in queries.op3_secret_scan(spark, sf).collect():
        found = []
        for i, (p, group, least) in enumerate(zip(patterns, (2, 0, 0), (6, 20, 24))):
            found += [(m.start(), i, m.end()) for m in re.finditer(p, docs[r["doc_id"]]["text"] or "") if len(m[group]) >= least]
        base = ",".join(f"{('assign', 'access', 'hex')[i]}:{a}:{b}" for a, i, b in sorted(found))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(i == k for _, i, _ in found) for k in range(3)]


def test_op6(spark, sf, docs):
    v = token_counts.piece_vocabulary(queries.tokenizer_path("piece_bpe_32k.model"))
    longest = max(map(len, v.scores))
    for r in queries.op6_token_counts(spark, sf).where("doc_id % 4 = 0").collect():
        words = (docs[r["doc_id"]]["text"] or "").split()
        assert r["n_words"] == len(words) and r["n_tokens"] == sum(token_counts.segment(v.prefix + w, v, longest) for w in words)


def test_op8(spark, sf, docs):
    def phrases(t):
        out, w = set(), ""
        for c in t:
            w += c
            if w not in out:
                out.add(w)
                w = ""
        return out | ({w} if w else set())

    got = {r["doc_id"]: r for r in queries.op8_lz_fingerprint(spark, sf).collect()}
    order = sorted(docs, reverse=True)
    off = []
    for i, following in zip(order, order[1:] + order[:1]):
        t, n = docs[i]["text"], docs[following]["text"]
        edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["fingerprint"] == lz_fingerprint.encode(lz_fingerprint.fingerprint(t)) and got[i]["edited_fingerprint"] == lz_fingerprint.encode(lz_fingerprint.fingerprint(edited))
        a, b, c = phrases(t), phrases(edited), phrases(n)
        off += [abs(len(a & b) / len(a | b) - got[i]["near_edited"]), abs(len(a & c) / len(a | c) - got[i]["near_next"])]
    assert np.mean(off) < 0.05 and max(off) < 0.25


def test_op9(spark, sf, docs):
    def dice(a, b):
        a, b = license_scan.bigrams(a), license_scan.bigrams(b)
        return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0

    got = {r["doc_id"]: r for r in queries.op9_license_scan(spark, sf).collect()}
    for i, r in docs.items():
        best = max((dice(line, t) for line in (r["text"] or "").split("\n") if len(line) < 1000 for _, t in license_scan.TEMPLATES), default=0.0)
        assert (got[i]["dice"] or 0.0) == pytest.approx(best if best >= 0.8 else 0.0)


def test_op9_against_all_segments(spark, sf, docs):
    """The best licence of short documents, over every line and every run of lines."""
    templates = [(i, license_scan.bigrams(t)) for i, t in license_scan.TEMPLATES + license_scan.licences()]
    known = frozenset().union(*[g for _, g in templates])
    got = {r["doc_id"]: r for r in queries.op9_license_scan(spark, sf).collect()}
    tried = 0
    for i, r in docs.items():
        lines = (r["text"] or "").split("\n")
        if len(lines) > 40 or len(r["text"] or "") > 20_000:
            continue
        tried += 1
        plain = ["" if re.match(r"(?i)\W*(?:copyright|\(c\)|©).*\d{4}", x) else x for x in lines]
        segments = lines + ["\n".join(plain[a:b]) for a in range(len(lines)) for b in range(a + 2, len(lines) + 1)]
        best = (False, 0.0)
        for passage in set(segments):
            own = license_scan.bigrams(passage)
            if own and not known.isdisjoint(own):
                best = max(best, *[(name != "proprietary", d) for name, g in templates if (d := 2 * len(own & g) / (len(own) + len(g))) >= 0.8] or [best])
        assert (got[i]["dice"] or 0.0) == pytest.approx(best[1]), i
    assert tried > 50


def test_op10_prediction_is_the_linear_model(spark, sf, docs):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(table)
    got = {r["doc_id"]: r for r in language_id.identify(table, model=model).collect()}
    for i in list(docs)[:20]:
        folded = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in docs[i]["text"].lower().encode())
        z, n = np.zeros(len(model.langs)), 0
        for g, k in enumerate(language_id.GRAMS):
            for at in range(len(folded) - k + 1):
                key = int.from_bytes(folded[at : at + k], "little") * 2654435761 % 2**32 >> 16
                z += model.table[g * language_id.BUCKETS + key]
                n += 1
        p = np.exp((z / n + model.bias) / model.temperature - max((z / n + model.bias) / model.temperature))
        assert got[i]["lang_pred"] == model.langs[int(p.argmax())] and got[i]["score"] == pytest.approx(p.max() / p.sum(), abs=1e-4)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_pipeline_against_brute_force(spark, sf, docs):
    pieces = corpus_pipeline.run(spark, sf).collect()
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rejected = {r["doc_id"] for r in language_id.identify(table).where("rejected").collect()}
    text = {i: r["text"] for i, r in docs.items() if i not in rejected}
    lines = brute_lines(text.items())
    shared = {}
    for i, t in text.items():
        for line in t.split("\n"):
            k = line.strip(" \t\n\x0b\x0c\r")
            k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)
            shared.setdefault(k, set()).add(i)
    kept = {}
    for i, t in text.items():
        rest = [x for x in t.split("\n") for k in ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))] if not (len(k) >= 20 and len(shared[k]) >= 3 and i != max(shared[k]))]
        assert hashlib.sha256("\n".join(rest).encode()).hexdigest() == lines[i][2]
        if rest:
            kept[i] = "\n".join(rest)
    classes = near_classes(kept.items())
    kept = {i: t for i, t in kept.items() if classes[i] == i}
    # mixing: whole documents in hash order; the one at the budget's edge goes in if at least half of it fits
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in kept.items()}
    sources = sorted({docs[i]["source"] for i in kept}, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(sources)}
    total = {s: sum(size[i] for i in kept if docs[i]["source"] == s) for s in sources}
    free, target, left = set(sources), {}, float(sum(total.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
        free -= over
    copies = {}
    for s in sources:
        budget = int(np.floor(target[s] + 0.5))
        whole, rest = divmod(budget, total[s])
        own = sorted((int(hashlib.md5(f"mix|{i}|{hashlib.md5(kept[i].encode()).hexdigest()}".encode()).hexdigest()[:15], 16), i) for i in kept if docs[i]["source"] == s)
        for _, i in own:
            take = size[i] > 0 and (rest >= size[i] or (rest > 0 and 2 * rest >= size[i]))
            copies[i] = whole + take
            rest = max(0, rest - size[i]) if rest >= size[i] else 0
    ids = dict(zip(kept, encoded(kept.values())))
    assert check_packing(pieces, {k: [v] for k, v in ids.items()}) == sum(copies[i] * len(ids[i]) for i in kept)
    starts = {}
    for p in pieces:
        starts[p["doc_id"]] = starts.get(p["doc_id"], 0) + (p["start"] == 0)
    assert starts == {i: n for i, n in copies.items() if n}


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).withColumns({"rejected": F.lit(1), "size": F.lit("x"), "class_id": F.lit(2), "_row": F.lit(3)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
