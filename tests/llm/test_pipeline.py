from __future__ import annotations

import os
import zlib
from collections import defaultdict

import numpy as np
from test_operators import brute_components, brute_measures, brute_spans
from tokenizers import Tokenizer

import corpus_pipeline
from tesserine.llm import bpe


def brute_quality(docs):
    """Text rules, then a beta prior by moments for each rule over hosts; a host goes when a rate, less 1.645 deviations, is over halfway from the mean to 1."""
    broken = []
    for d in docs:
        words, chars, symbols, dup, repeated = brute_measures(d["text"])
        full = sum(1 for x in (d["text"] or "").split("\n") if x.strip(" \t\n\x0b\x0c\r"))
        broken.append((words < 50, 100 * repeated > 50 * words, 10 * symbols > chars, dup > 0 and 2 * dup > full))
    hosts, worst = defaultdict(list), defaultdict(bool)
    for d, b in zip(docs, broken):
        if d["source"] is not None:
            hosts[d["source"]].append(b)
    total = sum(map(len, hosts.values()))
    for rule in range(4):
        failed = {h: sum(b[rule] for b in own) for h, own in hosts.items()}
        m = sum(failed.values()) / total
        spread = sum(len(own) * (failed[h] / len(own) - m) ** 2 for h, own in hosts.items())
        share = total - sum(len(own) ** 2 for own in hosts.values()) / total
        between = (spread - (len(hosts) - 1) * m * (1 - m)) / share if share > 0 else 0
        strength = max(1, m * (1 - m) / between - 1) if between > 0 else total
        for h, own in hosts.items():
            rate = (failed[h] + m * strength) / (len(own) + strength)
            worst[h] |= rate - 1.645 * (rate * (1 - rate) / (len(own) + strength + 1)) ** 0.5 > m + 0.5 * (1 - m)
    return [d for d, b in zip(docs, broken) if not b[0] and not b[1] and not worst[d["source"]]]


def brute_line_dedup(docs):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    where = defaultdict(set)
    for d in docs:
        for x in (d["text"] or "").split("\n"):
            where[key(x)].add(d["doc_id"])
    stays = lambda d, x: len(key(x)) < 40 or len(where[key(x)]) < 5 or max(where[key(x)]) == d["doc_id"]
    return [d | {"text": d["text"] and "\n".join(x for x in d["text"].split("\n") if stays(d, x))} for d in docs]


def brute_near_dedup(docs):
    found = brute_components([(d["doc_id"], d["text"]) for d in docs])
    return [d for d in docs if found[d["doc_id"]][1] == d["doc_id"]]


def brute_redact(docs):
    out = []
    for d in docs:
        runs = []
        for span in filter(None, brute_spans(d["text"]).split(",")):
            start, end = map(int, span.split(":")[1:])
            if runs and start < runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], end)
            else:
                runs.append([start, end])
        text = d["text"]
        for start, end in reversed(runs):
            text = text[:start] + "[secret]" + text[end:]
        out.append(d | {"text": text})
    return out


def brute_pieces(docs):
    library, out = Tokenizer.from_file(bpe.default_path()), []
    for d in docs:
        ids = np.array([*library.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        starts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048)]  # the first piece is the short one
        for p, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            out.append((d["doc_id"], p, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    return out


def test_every_stage_of_run_against_brute_force(spark, sf_dir, monkeypatch):
    seen, store = [], corpus_pipeline.materialize

    def kept(df, label, **options):
        seen.append(store(df, label, **options))
        return seen[-1]

    monkeypatch.setattr(corpus_pipeline, "materialize", kept)
    monkeypatch.setattr(corpus_pipeline, "release", lambda docs: None)  # all stages' results are read below
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    docs = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = lambda docs: sorted((tuple(d.values()) for d in docs), key=repr)
    assert len(seen) == 5
    for brute, df in zip((brute_quality, brute_line_dedup, brute_near_dedup, brute_redact), seen):
        before, docs = docs, brute(docs)
        assert rows(r.asDict() for r in df.collect()) == rows(docs) != rows(before), brute.__name__
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(brute_pieces(docs))
    sequences = defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in map(sorted, sequences.values()):
        sizes = [n for _, n in own]
        assert [o for o, _ in own] == [sum(sizes[:i]) for i in range(len(sizes))] and sum(sizes) <= 2048
    assert sorted(sequences) == list(range(len(sequences)))


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] > counts[3] == counts[4]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_odd_rows_through_all_stages(spark, sf_dir):
    """Nulls in any column, empty and long texts, repeated rows, columns with the operators' own names."""
    words = lambda n, k: " ".join(f"w{(i * 7919 + k) % 100_003}" for i in range(n))
    line = "a line of more than forty characters that is in many documents"
    texts = [None, "", "  ", words(60, 1), words(60, 1), words(30_000, 2), words(50, 3) + " token=abcdefghijkl0123"]
    texts += [f"{words(55, 10 + i)}\n{line}" for i in range(6)]
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), i, i, i, i) for i, t in enumerate(texts)]
    rows += [rows[3], (None, words(70, 50), None, None, None, None, None, None, None)]
    names = ["doc_id", "text", "lang", "source", "n_chars", "__id", "__Blob", "c1", "kept"]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'string' if n in ('text', 'lang', 'source') else 'bigint'}" for n in names))
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "odd")
        assert docs.columns == names
        seen.append(docs.collect())
    quality, lines, near, secret = ([r.doc_id for r in s] for s in seen)
    assert sorted(quality, key=str) == sorted([3, 3, 4, 5, 6, *range(7, 13), None], key=str)
    assert {r.doc_id for r in seen[1] if line in r.text} == {12}
    assert sorted(near, key=str) == sorted([3, 3, 5, 6, *range(7, 13), None], key=str)  # the copy of 3 goes, both rows of 3 stay
    assert [r.text for r in seen[3] if r.doc_id == 6] == [words(50, 3) + " [secret]"]
    assert all(r["__id"] == r.doc_id == r.c1 for r in seen[3])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.where("piece = 0").count() == len(secret)


def test_run_leaves_only_its_result(spark, sf_dir):
    from tesserine.llm import store

    folder = f"{store.shared_dir(spark)}/tesserine".removeprefix("file:")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, sf_dir)
    left = set(os.listdir(folder)) - before
    assert {x.rpartition("-")[0] for x in left} == {"packing"} and out.count() > 0
