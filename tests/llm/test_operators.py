"""Each operator against a brute-force version on small tables that hold nulls, empty and long texts, ties, repeated rows
and columns whose names clash with those of results."""

import datetime
import hashlib
import json
import math
import os
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexloom.llm import bpe, chat, decontaminate, embeddings, licenses, simhash, store, tiles, toxicity, urls, warc
from lexloom.llm.common import connected_components, shared_dir

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, data string, score double"


def docs_of(frame, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return frame([(i, t, "en", "hot", len(t or ""), 7, "x", 0.5) for i, t in zip(ids, texts)], DOCS)


def components(n, linked):
    low = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if linked(i, j) and low[j] < low[i]:
                    low[i], changed = low[j], True
    return low


# 1 SimHash


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_anchors_bring_every_near_pair_together():
    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 63), 1 << 63, 300, np.int64)
    flips = np.array([np.bitwise_xor.reduce([1 << int(b) if b < 63 else -(1 << 63) for b in rng.choice(64, k, replace=False)]) if k else 0 for k in rng.integers(0, 4, 300)], np.int64)
    both = np.concatenate((base, base ^ flips))
    index, bucket, home = simhash.anchors(both)
    homes = {(int(b), int(i)) for i, b, h in zip(index, bucket, home) if h}
    near = {(int(b), int(i)) for i, b in zip(index, bucket)}
    for i in range(300):
        assert any((b, i) in homes and (b, i + 300) in near for b, k in homes if k == i), i
    assert len(index) <= 34 * len(both)


def test_simhash_links_like_brute_force(frame, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 2)
    rng = np.random.default_rng(7)
    vocabulary = [f"w{k}" for k in range(300)]
    base = list(rng.choice(vocabulary, 120))
    texts = [None, "", " \t\n", "One", "one", "two words", "ÀÉ nön ascii", " ".join(base), " ".join(base).upper(), "x " * 30000]
    for _ in range(40):
        near = base.copy()
        near[rng.integers(120)] = "changed"
        texts.append(" ".join(near))
    texts += [" ".join(rng.choice(vocabulary, 30)) for _ in range(10)]
    prints = [plain_fingerprint(t) for t in texts]
    low = components(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(frame, texts)).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].fingerprint, got[i].component_id) == (f"{prints[i]:016x}", low[i]), texts[i]
    tiny = simhash.links(docs_to_prints(frame, prints), tile=1)
    roots = {r.node: r.root for r in connected_components(tiny).collect()}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    for i in range(len(texts)):
        for j in range(i):
            same = roots.get(signed[i], signed[i]) == roots.get(signed[j], signed[j])
            assert same == (low[i] == low[j])
    kept = {r.doc_id for r in simhash.keep_first(docs_of(frame, texts)).collect()}
    assert kept == set(low)


def docs_to_prints(frame, prints):
    return frame(sorted({(p - (1 << 64) if p >> 63 else p,) for p in prints}), "fp bigint")


def test_simhash_edges(frame):
    assert simhash.near_duplicates(docs_of(frame, [])).collect() == []
    repeated = docs_of(frame, ["a b c d", "a b c d", "a b c d"], [5, 5, None])
    got = simhash.near_duplicates(repeated).collect()
    assert [r.component_id for r in got] == [5, 5, 5]
    kept = simhash.keep_first(repeated)
    assert kept.columns == repeated.columns and [r.doc_id for r in kept.collect()] == [5]


def test_keep_first_decides_by_row(frame):
    """One row of each group stays, whatever ids repeat; a row that is alone is never lost."""
    long = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcd"]
    rows = [(1, long[0], 7), (5, long[0], 7), (5, long[1], 7), (6, long[2], 7), (6, long[3], 7), (6, long[3], 7), (None, long[0], 7), (None, None, 7), (9, "", 7), (9, " ", 8)]
    df = frame(rows, "id bigint, fp string, row_key int").withColumnRenamed("fp", "text")
    kept = simhash.keep_first(df, "id", "text")
    assert kept.columns == df.columns
    got = sorted((str(r.id), r.text) for r in kept.collect())
    # of null and blank texts, which are one group, id 9 stays: of its two rows the one with the smaller hash
    assert [x for x in got if x[0] != "9"] == sorted([("1", long[0]), ("5", long[1]), ("6", long[2]), ("6", long[3])])
    assert len(got) == 5 and [x for x in got if x[0] == "9"][0][1] in ("", " ")
    assert sorted((str(r.id), r.text) for r in simhash.keep_first(df.orderBy(F.desc("text")).repartition(3), "id", "text").collect()) == got
    nested = df.withColumn("more", F.create_map(F.lit("k"), F.col("text"))).withColumn("a.b", F.lit(1))
    assert simhash.keep_first(nested, "id", "text").columns == nested.columns and simhash.keep_first(nested, "id", "text").count() == 5
    assert simhash.keep_first(df.limit(0), "id", "text").collect() == []


def test_large_buckets_are_cut_by_all_their_rows(spark):
    """No tile holds more than a share of a bucket, home rows or not, and every home row still meets every row."""
    rows = [(1, i < 3, i) for i in range(400)] + [(2, i < 300, 1000 + i) for i in range(320)] + [(3, False, 2000 + i) for i in range(500)] + [(4, True, 3000), (4, False, 3001)]
    df = spark.createDataFrame(rows, "bucket bigint, home boolean, n bigint")
    out = tiles.tiled(df, 10, "n", 4).collect()
    cells = {}
    for r in out:
        cells.setdefault((r.key, r.bucket), []).append(r)
    assert max(map(len, cells.values())) < 10 * (1 + tiles.WIDE) * 4 and 3 not in {r.bucket for r in out}
    met = {(a.n, b.n) for cell in cells.values() for a in cell if a.kind & 1 for b in cell if b.kind & 2}
    assert met == {(a[2], b[2]) for a in rows if a[1] for b in rows if b[0] == a[0]}


def test_components_of_a_long_path_and_a_hub(frame):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1100)] + [(3, 3)]
    got = {r.node: r.root for r in connected_components(frame(edges, "a bigint, b bigint")).collect()}
    assert all(got.get(i, i) == 100 for i in range(100, 161)) and all(got[i] == 7 for i in range(1000, 1100)) and 3 not in got


# 2 Licenses


def plain_blocks(text, templates, threshold=licenses.THRESHOLD):
    """Labels and largest parts by every block of every template, without a filter."""
    words, out = licenses.tokens(text or ""), {}
    for label, template in templates.items():
        whole, span = set(licenses.tokens(template)), licenses.window_of(len(licenses.tokens(template)), threshold)
        held = max((len(whole & set(words[k : k + span])) for k in range(len(words))), default=0)
        if whole and held >= licenses.need_of(len(whole), threshold):
            out[label] = held / len(whole)
    return out


def plain_phrases(text):
    words = licenses.tokens(text or "")
    found = []
    for phrase, label in licenses.PHRASES.items():
        ws = phrase.split()
        found += [(k, label) for k in range(len(words)) if words[k : k + len(ws)] == ws]
    return sorted(found)


def check_scan(got, texts, templates):
    for i, text in enumerate(texts):
        r, base, more = got[i], plain_phrases(text), plain_blocks(text, templates)
        assert (r.n_words, r.n_base) == (len(licenses.tokens(text or "")), len(base)), text
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None)), text
        assert r.base_labels == ",".join(sorted({x for _, x in base})), text
        assert r.labels == ",".join(sorted({x for _, x in base} | set(more))), text
        assert r.score == (1.0 if base else max(more.values(), default=0.0)), text
        assert {b.label: max(x.part for x in r.blocks if x.label == b.label) for b in r.blocks} == more, text


def test_license_scan(frame):
    texts = [
        None, "", "Released under the MIT License.", "mit LICENSE mit license", "mit\nlicense", "x\nLicensed under the Apache License, Version 2.0.\ny",
        "GNU General Public License, version 3; this work is licensed under the", "Licensed under CC BY-NC 4.0", "license " * 20000, "apache licensé",
        "under the mit filler filler filler filler license released", "Released filler under filler the MIT License",
    ]
    got = {r.doc_id: r for r in licenses.scan(docs_of(frame, texts)).collect()}
    assert (got[0].n_words, got[0].labels, got[0].score, got[0].first_word) == (0, "", 0.0, None)
    assert got[2].labels == "mit,mit-notice" and "apache-notice" in got[5].labels and "gpl-notice" in got[6].labels and got[7].labels == "cc-notice"
    check_scan(got, texts, licenses.TEMPLATES)
    assert licenses.scan(docs_of(frame, [])).collect() == []
    bare = licenses.scan(docs_of(frame, ["mit license", None]), phrases={}, templates={"none": " . "}).collect()
    assert [(r.labels, r.n_base, r.blocks) for r in bare] == [("", 0, [])] * 2
    assert [(b.word, b.label, b.part) for b in got[2].blocks] == [(0, "mit-notice", 1.0)]


def test_license_scan_reads_wrapped_notices(frame):
    templates = licenses.TEMPLATES
    texts, holds = [], []
    for label in ("mit-text", "bsd", "mpl-2.0", "apache-2.0", "isc", "gpl"):
        for width in (15, 40, 72, 80):
            for mark in ("", "// ", " * "):
                lines = textwrap.wrap(templates[label] + ". More words stand on the last line, as they do in most files", width)
                texts.append("Ein Satz davor\n\n" + "\n".join(mark + line for line in lines) + "\n\ntext after it")
                holds.append(label)
    notice = textwrap.fill(templates["mit-text"], 72)
    texts += [notice.replace("\n", "\r\n\r\n"), "\n".join([notice] * 50), "\n".join(["word " * 25, notice[:60], "word " * 25, notice[60:]])]
    got = {r.doc_id: r for r in licenses.scan(docs_of(frame, texts)).collect()}
    check_scan(got, texts, templates)
    assert all(label in got[i].labels.split(",") and got[i].score == 1.0 for i, label in enumerate(holds))
    n, size = len(holds), len(licenses.tokens(templates["mit-text"]))
    whole = [b.word for b in got[n + 1].blocks if b.label == "mit-text"]
    assert len(whole) >= 40 and all(b - a >= size for a, b in zip(whole, whole[1:]))


def test_license_scan_with_a_thousand_templates(frame, monkeypatch):
    rng = np.random.default_rng(11)
    common, rare = [f"c{k}" for k in range(30)], [f"r{k}" for k in range(3000)]
    templates = {f"t{k}": " ".join([*rng.choice(common, 6), *rng.choice(rare, 6)]) for k in range(1000)}
    texts = [None, " ".join(rng.choice(common, 400))]
    for k in range(40):
        words = templates[f"t{rng.integers(1000)}"].split()
        for _ in range(int(rng.integers(0, 5))):
            words.insert(int(rng.integers(len(words))), str(rng.choice(common)))
        if k % 3 == 0:
            words = [str(w) for w in rng.permutation(words)][: int(rng.integers(7, 14))]
        texts.append(" ".join([*rng.choice(common, 50), *words, *rng.choice(rare, 20)]))
    docs = docs_of(frame, texts)
    got = {r.doc_id: r for r in licenses.scan(docs, templates=templates).collect()}
    check_scan(got, texts, templates)
    assert sum(r.score > 0 for r in got.values()) > 20
    monkeypatch.setattr(licenses, "MOST_BROADCAST", 5)  # the join by a shuffle gives the same
    assert {r.doc_id: r.labels for r in licenses.scan(docs, templates=templates).collect()} == {i: r.labels for i, r in got.items()}
    plan = licenses.scan(docs, templates=templates)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 200_000  # no expression for each template


# 3 WARC


def test_warc_round_trip_rejects_magic_inside_payloads(spark, frame, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT", 3)
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    html = [None, "", "short", "short", "é" * 60, "é" * 60, "é" * 60, "x\n" + inner * 3 + "tail", "\n" + inner, inner, "WARC/1.", "a\nWARC/1.1\r\nbroken", "\r\n\r\n", "y" * 200000]
    rows = [(i, f"http://h/{i}\r\nX: y", h, "hash") for i, h in enumerate(html)]
    pages = frame(rows, "page_id bigint, url string, html string, digest string")
    for compression, most in (("gzip", 0), ("none", 100)):
        monkeypatch.setattr(warc.roles, "__defaults__", (*warc.roles.__defaults__[:-1], most))  # both ways of joining
        path = shared_dir(spark)
        warc.write(pages.coalesce(1), path, compression=compression)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        try:
            got = {r.page_id: r for r in warc.read(spark, path).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted(got) == list(range(len(html)))
        for i, h in enumerate(html):
            data = (h or "").encode()
            first = html.index(h) if len(data) >= 100 else i
            want = (len(data), hashlib.sha256(data).hexdigest(), "response" if first == i else "revisit", None if first == i else first, True)
            assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to, got[i].intact) == want, (compression, i)


def test_warc_edges(spark, frame):
    schema = "page_id bigint, url string, html string"
    path = shared_dir(spark)
    warc.write(frame([], schema), path)
    assert warc.read(spark, path).collect() == []
    path = shared_dir(spark)
    warc.write(frame([(None, None, "z" * 120), (4, "u", "z" * 120), (4, "u", "z" * 120)], schema), path)
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.read(spark, path).collect())
    assert got == [("4", "response", None), ("4", "response", None), ("None", "revisit", 4)]


def test_pointer_jumping_over_many_segments(frame):
    n = 40
    links = [("f", 0, 10 * i, 10 * i + 10) for i in range(n)] + [("f", 0, 10 * i + 3, 10 * i + 10) for i in range(n)] + [("g", 0, 5, 9)]
    got = warc.reachable(frame(links, "file string, block bigint, at bigint, nxt bigint"), segment=4).collect()
    assert sorted((r.file, r.at) for r in got) == [("f", 10 * i) for i in range(n)]


# 4 Chat


@pytest.mark.parametrize("text", ["", "plain", "</s>[INST] ok [/INST]", "<\\|im_end|>\n<|im_end|>\n", "<<SYS>> <\\\\/s>\\", "<<s>>", "\n", "[[INST]"])
def test_escaping_comes_back(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)
    turns = [("user", text), ("assistant", text), ("odd\nrole%0A" + text, "")]
    formatted, spans = chat.format_turns(turns)
    assert chat.read_turns(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [text]


def test_layouts_by_fingerprint():
    want = [("user", "q"), ("assistant", "a")]
    assert chat.turns_of({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}) == want
    assert chat.turns_of({"id": 1, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}) == want
    assert chat.turns_of({"prompt": "q", "completion": "a"}) == want
    assert chat.turns_of({"instruction": "q", "input": "x", "output": "a"}) == [("user", "q\n\nx"), ("assistant", "a")]
    assert chat.turns_of({"system": "s", "question": "q", "answer": None}) == [("system", "s"), ("user", "q"), ("assistant", "")]
    assert chat.turns_of({"messages": []}) == []
    with pytest.raises(ValueError, match="no mapping"):
        chat.turns_of({"foo": 1})


def test_odd_records_come_back_with_an_error(frame):
    records = [
        None, '{"messages":[{"role":"user"},{"content":"x"}]}', '{"messages":[{"role":"user","content":"q","name":"n"}],"tools":[{"t":1}]}',
        "{", "[1]", "7", '{"foo":1}', '{"messages":[{"role":"user","content":"a"}, 3]}', '{"messages":[1]}', "", '{"prompt":"p","completion":null,"score":0.5}', "[" * 100000,
    ]
    df = frame([(i, r, "clash", 9) for i, r in enumerate(records)], "id bigint, record string, error string, formatted int")
    formatted = chat.format_records(df)
    got = {r.id: r for r in formatted.collect()}
    good = {0: [], 1: [("user", ""), ("", "x")], 2: [("user", "q")], 10: [("user", "p"), ("assistant", "")]}
    for i, r in got.items():
        if i in good:
            assert r.error is None and r.n_turns == len(good[i]) and chat.read_turns(r.formatted) == good[i]
        else:
            assert r.error and r.formatted is None and r.spans is None and r.n_turns is None, records[i]
    assert {r.id for r in chat.quarantined(formatted).collect()} == got.keys() - good.keys()
    assert {r.id for r in chat.read_digests(chat.accepted(formatted)).collect()} == set(good) == {r.id for r in chat.read_digests(formatted).collect()}
    assert chat.format_records(df.limit(0)).collect() == []


def test_chat_query_goes_through_several_layouts(spark, frame, tmp_path):
    rng = np.random.default_rng(12)
    rows = []
    for c in range(60):
        roles = [["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant"] * 3, ["human", "assistant"], ["user", None, "tool"]][c % 5]
        for turn, role in enumerate(roles):
            rows.append((c, turn, role, None if rng.random() < 0.1 else rng.choice(["hi", "<s>[INST]", "", "é\n<|im_end|>\n", "x" * 50]), 1.5))
    rows += [(1, 0, "user", "same turn", 1.5), (None, 0, "user", "no id", 1.5), (None, None, "assistant", "no turn", 1.5)]
    frame(rows, "conv_id bigint, turn bigint, role string, text string, record double").write.parquet(f"{tmp_path}/conversations.parquet")
    records = chat.records_of(spark.read.parquet(f"{tmp_path}/conversations.parquet"), mixed=True)
    used = {chat.fingerprint(chat.paths(json.loads(r.record))) for r in records.collect()}
    assert len(used) >= 5
    got = {r.conv_id: r for r in chat.op4_chat_format(spark, str(tmp_path)).collect()}
    probe = [("user", chat.PROBE), ("assistant", chat.PROBE)]
    want = {-7: probe}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        want[c] = [(r[2] or "", r[3] or "") for r in own]
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        text = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest()), c
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()), c
        assert got[c].formatted_chars == len(chat.format_turns(turns)[0])


def test_conversations(spark, frame):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, None, None, "first"), (1, 2, "assistant", "a"), (1, 2, "assistant", "a"), (None, 0, "user", "x"), (2, 0, "assistant", "é👍" * 50000)]
    turns = frame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.read_digests(chat.format_records(chat.records_of(turns), "conv_id"), "conv_id").collect()}
    text = "\nfirst\nuser\n\nassistant\na\nassistant\na\nassistant\nb\n"
    assert got[1].turns_sha256 == hashlib.sha256(text.encode()).hexdigest() and (got[1].n_turns, got[1].loss_chars) == (5, 3)
    assert got[2].loss_chars == 100000 and got[None].loss_chars == 0
    assert chat.records_of(turns.limit(0)).collect() == []


# 5 URL filters


def test_url_filter(frame):
    events = [("bad.com", "block", "2024-01-10"), ("bad.com", "remove", "2024-02-10"), ("ok.bad.com", "allow", "2024-01-15"), ("x.org/a", "block", "2024-01-01"), (None, "block", "2024-01-01"), ("tie.com", "block", "2024-01-01"), ("tie.com", "allow", "2024-01-01")]
    rows = [
        ("http://www.BAD.com/x", "2024-01-09"), ("http://www.BAD.com/x", "2024-01-10"), ("http://www.bad.com/x", "2024-02-10"), ("https://ok.bad.com:80/", "2024-01-20"),
        ("http://x.org/a/b?q#f", "2024-01-01"), ("http://x.org/ab", "2024-01-01"), ("http://u@x.org./a", "2024-01-01"), (None, "2024-01-01"), ("nonsense", "2024-01-01"),
        ("http://bad.com", None), ("http://tie.com/", "2024-03-01"), ("http://www.BAD.com/x", "2024-01-10"),
    ]
    got = urls.judge(
        frame([(i, u, d, True) for i, (u, d) in enumerate(rows)], "page_id int, url string, day string, blocked boolean"),
        frame(events, "key string, action string, day string").selectExpr("key", "action", "cast(day as date) day"),
    )
    blocked = {r.page_id: r.blocked for r in got.collect()}
    assert [blocked[i] for i in range(len(rows))] == [False, True, False, False, True, False, True, False, False, False, False, True]
    assert got.where("page_id = 3").first().entry == "ok.bad.com"
    assert urls.judge(got.drop("blocked").limit(0).selectExpr("url", "day"), frame([], urls.EVENTS)).collect() == []


def test_url_query_equals_a_plain_scan(spark, frame, tmp_path):
    hosts = ["a.b.example.com", "b.example.com", "example.com", "EXAMPLE.com.", "x.org", "x.co.uk", "localhost", ".".join(["s"] * 45) + ".deep.net"]
    paths = ["", "/", "/en", "/en/x?q=1", "/en//x#f", "/" + "/".join(f"p{k}" for k in range(60)), "/caf\u00e9"]
    rows = [(i, f"http{'s' * (i % 2)}://{'u@' * (i % 3 == 0)}{h}{':80' * (i % 5 == 0)}{p}", "clash") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)]
    rows += [(1000, None, "x"), (1001, "nonsense", "x"), (None, "http://x.org/en", "x"), (3, "http://example.com/en", "x"), (3, "http://example.com/en", "x"), (1002, "http://\u0000", "x")]
    frame(rows, "page_id bigint, url string, action string").write.parquet(f"{tmp_path}/pages.parquet")
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet")
    spans = [tuple(r) for r in urls.intervals(urls.dated_list(pages)).collect()]
    assert len(spans) > 20
    got = sorted(urls.op5_url_filter(spark, str(tmp_path)).collect(), key=str)
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append((r.n_active, r.entry, r.blocked))
    for page, url, _ in rows:
        m = re.match(r"[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)", url or "")
        host, path = (m[1].lower().rstrip("."), [p for p in m[2].split("/") if p]) if m else ("", [])
        labels = host.split(".")
        ends = [".".join(labels[k:]) for k in range(len(labels))] if host else []
        keys = {e + "".join("/" + p for p in path[:k]) for e in ends for k in range(len(path) + 1)}
        day = None if page is None else datetime.date(2024, 1, 1) + datetime.timedelta(page % 366)
        active = [(len(k), a == "allow", k) for k, a, since, until in spans if day and k in keys and since <= day < until]
        top = max(active, default=None)
        assert (len(active), top and top[2], bool(top and not top[1])) in by[page], url
    frame([], "page_id bigint, url string").write.parquet(f"{tmp_path}/empty/pages.parquet")
    assert urls.op5_url_filter(spark, f"{tmp_path}/empty").collect() == []


# 6 and 7 Token ids

LONG = "Whstionthe " * 9000
TEXTS = [None, "", " ", "Hello, World! it's 42 ½", "<|endoftext|> a<|startoftext|>", "é ÉTÉ ΣΑΣ İ", "日本語 👍🏽\u0085x y​z", "word" * 300, LONG, LONG, LONG + " other end", "\x00 \x1c a", "ſ ﬁ Å ʼn"]


def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_equals_the_library(frame):
    t = library()
    got = {r.doc_id: r for r in bpe.encode(docs_of(frame, TEXTS)).collect()}
    for i, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids), text
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs_of(frame, TEXTS)).select("doc_id", "ids"))
    assert {r.doc_id: r.text for r in back.collect()}[4] == t.decode(list(got[4].ids), skip_special_tokens=False)
    odd = frame([(1, [0, None, 99999999, 49407]), (2, None)], "doc_id int, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(odd, skip_special_tokens=True).collect()} == {1: "!", 2: ""}
    assert bpe.encode(docs_of(frame, [])).collect() == []


def test_backtracking_equals_plain_merging():
    tables = bpe.tables_of(bpe.default_path())
    coder = bpe.Coder(tables)
    symbol = {tables.texts[k]: k for k in range(tables.n_base)}
    rng = np.random.default_rng(3)
    for _ in range(3000):
        word = "".join(rng.choice(list("aeinorst lhéñ".replace(" ", "")), rng.integers(1, 14)))
        text = "".join(coder.chars[b] for b in word.encode()) + bpe.END
        assert coder.tokens_of(text) == tables.merge(text, symbol), word


def test_store(spark, frame):
    path = shared_dir(spark)
    ids = [9, 3, None, 5, 5, 0, 1, 2, 4, 6, 7, 8, 10]
    store.write(docs_of(frame, TEXTS, ids), path)
    t, at = library(), 0
    expected = sorted(zip(ids, TEXTS), key=lambda x: (x[0] is not None, x[0] or 0))
    got = store.read_digests(spark, path).orderBy("start").collect()
    whole = {r.start: list(r.ids) for r in store.read(spark, path).collect()}
    assert [r.doc_id for r in got] == [i for i, _ in expected] and all(r.intact for r in got)
    by_id = {}
    for i, text in expected:
        by_id.setdefault(i, []).append([*t.encode(text or "", add_special_tokens=False).ids, 1])
    for r in got:
        own = whole[r.start]
        by_id[r.doc_id].remove(own)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)
    chunks = store.read_chunks(spark, path)
    assert chunks.count() == chunks.select("hash").distinct().count() < spark.read.parquet(f"{path}/recipes").selectExpr("explode(hashes)").count()
    for rows in ("part is null", "part is not null"):  # the root's row, and the parts
        manifest = spark.read.parquet(f"{path}/manifest").where(rows).agg(F.sum("documents"), F.sum("ids")).first()
        assert tuple(manifest) == (len(TEXTS), at)
    empty = shared_dir(spark)
    store.write(docs_of(frame, []), empty)
    assert store.read_digests(spark, empty).collect() == []


def damaged(spark, path, name, change):
    """A copy of a store with one of its tables changed."""
    copy = shared_dir(spark)
    for part in ("chunks", "recipes", "manifest"):
        df = spark.read.parquet(f"{path}/{part}")
        (change(df) if part == name else df).write.parquet(f"{copy}/{part}")
    return copy


def test_store_tells_what_was_tampered_with(spark, frame):
    path = shared_dir(spark)
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"], 900)) for _ in range(12)]
    store.write(docs_of(frame, texts), path)
    store.verify(spark, path)
    low = spark.read.parquet(f"{path}/recipes").agg(F.min("part").alias("a"), F.max("part").alias("b")).first()
    assert low.a < low.b
    swapped = F.when(F.col("part") == low.a, low.b).when(F.col("part") == low.b, low.a).otherwise(F.col("part")).cast("int")
    for name, change in (
        ("recipes", lambda df: df.where("doc_id <> 4")),
        ("recipes", lambda df: df.withColumn("part", swapped)),
        ("recipes", lambda df: df.withColumn("start", F.col("start") + (F.col("doc_id") == 3).cast("bigint"))),
        ("recipes", lambda df: df.where(F.col("part") != low.b)),
        ("manifest", lambda df: df.where(F.col("part").isNull() | (F.col("part") != low.a))),
        ("manifest", lambda df: df.where(F.col("part").isNotNull())),
    ):
        with pytest.raises(store.StoreError):
            store.read_digests(spark, damaged(spark, path, name, change))
    first = spark.read.parquet(f"{path}/chunks").agg(F.min("hash")).first()[0]
    holders = {r.doc_id for r in spark.read.parquet(f"{path}/recipes").where(F.array_contains("hashes", F.lit(first))).collect()}
    for change in (
        lambda df: df.where(F.col("hash") != F.lit(first)),
        lambda df: df.withColumn("payload", F.when(F.col("hash") == F.lit(first), F.overlay("payload", F.lit(b"zz"), F.lit(3))).otherwise(F.col("payload"))),
    ):
        bad = damaged(spark, path, "chunks", change)
        assert {r.doc_id for r in store.read_digests(spark, bad).where("not intact").collect()} == holders
        with pytest.raises(Exception, match="missing or altered"):
            store.read(spark, bad).collect()
    lost = damaged(spark, path, "recipes", lambda df: df.withColumn("hashes", F.when(F.col("doc_id") == 5, F.reverse("hashes")).otherwise(F.col("hashes"))))
    assert [r.doc_id for r in store.read_digests(spark, lost).where("not intact").collect()] == [5]


def test_store_query_leaves_no_folder(spark, frame, tmp_path):
    docs_of(frame, ["one two", None, "one two"], [1, 2, 2]).write.parquet(f"{tmp_path}/documents.parquet")
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    got = store.op6_token_store(spark, str(tmp_path)).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.intact) for r in got] == [(1, 0, 3, True), *sorted([(2, 3, r.n_tokens, True) for r in got[1:2]]), (2, 3 + got[1].n_tokens, got[2].n_tokens, True)]
    assert {got[1].n_tokens, got[2].n_tokens} == {1, 3}
    assert not {f for f in set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) - before if f.startswith("lexloom-")}
    whole = bpe.op7_bpe(spark, str(tmp_path)).collect()
    assert sorted(r.n_tokens for r in whole) == [0, 2, 2]


def adversarial(seed, n):
    """Texts that put the shortcuts of chunks and words to the test: letter case, combining marks, odd white space, added tokens."""
    rng = np.random.default_rng(seed)
    pieces = [
        "a", "B", "J", "j", "\u030c", "\u0301", "\u0300", "\u0327", "é", "É", "Σ", "σ", "ς", "İ", "ı", "ß", "ẞ", "ǰ", "Å", "\u212b", "ﬁ", "ſ", "ʼn", "Ǆ", "ŉ", "\u0345", "\u1f88",
        " ", "  ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "\ufeff", "\x00", "\x7f",
        "'", "'s", "'S", "'ll", "'T", "’s", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "<", ">", "</w>",
        "1", "12", "½", "²", "٣", "Ⅷ", ".", "...", "!?", "€", "你好", "한글", "\u1112\u1161\u11ab", "👍🏽", "👩\u200d💻", "क्षि", "ทำ", "ا\u0651", "wordpiece", "THE", "antidisestablishment",
    ]
    return ["".join(rng.choice(pieces, int(k))) for k in rng.integers(0, 40, n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shortcuts_equal_the_library_on_whole_texts(seed, monkeypatch):
    pass
    t = library()
    coders = [bpe.Coder(bpe.tables_of(bpe.default_path())), store._Encoder(open(bpe.default_path(), encoding="utf-8").read()).pieces]
    texts = adversarial(seed, 1500)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for coder in coders:
        coder.chunks.limit, coder.words.limit = 200, 100  # both memos overflow again and again
        for at in range(0, len(texts), 250):
            ids, ends = coder.encode_all(pa.array([x.encode() for x in texts[at : at + 250]], pa.binary()).slice(0))
            for k in range(250):
                assert ids[ends[k] : ends[k + 1]].tolist() == want[at + k], texts[at + k]
        sliced = pa.array([x.encode() for x in texts[:50]] + [None], pa.binary()).slice(7)
        ids, ends = coder.encode_all(sliced)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [*want[7:50], []]
    back = coders[0].decode_all(np.array([i for x in want for i in x]), np.cumsum([0, *map(len, want)])).to_pylist()
    assert [x.decode() for x in back] == [t.decode(x, skip_special_tokens=False) for x in want]


def test_chunks_follow_content():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 49000, 30000).astype(np.uint32)
    ends = store.cuts(ids)
    assert ends[-1] == len(ids) and all(b - a <= store.MOST for a, b in zip([0, *ends], ends)) and all(b - a >= store.LEAST for a, b in zip([0, *ends], ends[:-1]))
    moved = store.cuts(np.concatenate((ids[:50], ids)))
    assert len({e - 50 for e in moved} & set(ends)) > 0.8 * len(ends)
    assert store.cuts(np.zeros(20000, np.uint32))[-1] == 20000 and store.cuts(ids[:0]) == []
    data = [rng.bytes(int(n)) for n in rng.integers(0, 300, 20)]
    sizes = np.array([len(x) for x in data])
    after = sizes[::-1].cumsum()[::-1] - sizes
    assert np.bitwise_xor.reduce(store.shifted(np.array([zlib.crc32(x) for x in data]), after)) == zlib.crc32(b"".join(data))


# 8 Embeddings


def test_embeddings_link_like_brute_force(frame, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 4)
    rng = np.random.default_rng(4)
    rows = []
    for c in range(6):
        base = rng.normal(size=24)
        rows += [(base + rng.normal(size=24) * s).astype(np.float32).tolist() for s in (0, 0, 0.02, 0.05, 0.08, 0.1, 0.15, 0.2)]
    rows += rng.normal(size=(40, 24)).astype(np.float32).tolist()
    bad = [None, [], [0.0] * 24, [float("nan")] * 24, [None, 1.0], [float("inf"), 1.0], rows[0]]
    tables = [(i, v, (i // 8) % 3, 1.0) for i, v in enumerate(rows)] + [(1000 + i, v, 0 if i < 6 else None, 1.0) for i, v in enumerate(bad)]
    tables += [(2000, rows[0], 0, 1.0), (2000, rows[0], 0, 1.0), (2001, [2.0 * x for x in rows[0]], 0, 1.0), (2002, [1e-30, 2e-30], 0, 1.0), (2003, [1e30, 2e30], 0, 1.0)]
    df = frame(tables, "vec_id bigint, embedding array<float>, label int, weight double")
    ok = [embeddings.usable(v) and l is not None for _, v, l, _ in tables]
    n = len(tables)

    def linked(i, j):
        if i == j or not (ok[i] and ok[j]) or tables[i][2] != tables[j][2] or len(tables[i][1]) != len(tables[j][1]):
            return False
        a, b = np.array(np.float32(tables[i][1]), float), np.array(np.float32(tables[j][1]), float)
        return a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98

    matrix = [[linked(i, j) for j in range(n)] for i in range(n)]
    same_id = lambda i, j: matrix[i][j] or tables[i][0] == tables[j][0]
    low = components(n, same_id)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect())
    want = sorted((tables[i][0], sum(matrix[i]), tables[low[i]][0], tables[low[i]][0] == tables[i][0]) for i in range(n))
    assert got == want
    assert embeddings.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize(("size", "least"), [(64, 0.99), (256, 0.98), (768, 0.97)])
def test_recall_at_the_threshold(size, least):
    """Pairs whose cosine is exactly the threshold, the hardest that must be found."""
    rng = np.random.default_rng(size)
    n = 1500
    a, noise = (embeddings.units(rng.normal(size=(n, size))) for _ in range(2))
    noise = embeddings.units(noise - (noise * a).sum(1, keepdims=True) * a)
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * noise
    p, q = embeddings.buckets(a), embeddings.buckets(b)
    meet = ((q == p[:, :, :1]).any(2) | (p == q[:, :, :1]).any(2)).any(1)
    assert meet.mean() >= least
    far = embeddings.buckets(noise)
    assert ((far == p[:, :, :1]).any(2) | (p == far[:, :, :1]).any(2)).any(1).mean() < 0.01


# 9 Decontamination


@pytest.mark.parametrize("block_bytes", [1 << 24, 400])
def test_decontamination_equals_brute_force(spark, frame, block_bytes):
    rng = np.random.default_rng(5)
    vocabulary = ["alpha", "beta", "gamma", "delta", "É", "z9"]
    words = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, words(int(n))) for i, n in enumerate(rng.integers(1, 24, 20))] + [(20, None), (21, "  ,"), (3, words(12)), (10, "Solo"), (None, "no name here")]
    inside = items[5][1].upper().replace(" ", " -- ")
    texts = [None, "", "...", "solo", "x solo y solo", "no name here", "no name", "here no name here", f"start {inside} end", words(400), " ".join(["beta"] * 3000)] + [words(int(n)) for n in rng.integers(1, 40, 30)]
    docs, bench = docs_of(frame, texts), frame(items, "item_id bigint, text string")
    found = decontaminate.scan(docs, bench, block_bytes=block_bytes, keep_text=True)
    got = {r.doc_id: r for r in found.collect()}
    named = [(i, t) for i, t in items if i is not None]
    for doc, n, hit, n_items, digest, contaminated in decontaminate.brute(list(enumerate(texts)), named):
        r = got[doc]
        if doc in (5, 7):  # an item without an id marks its words, and is not listed
            assert (n_items, len(r["items"]), sum(s.stop - s.start for s in r.spans)) == (0, 0, 3)
            continue
        assert (r.n_words, sum(s.stop - s.start for s in r.spans), len(r["items"])) == (n, hit, n_items), texts[doc]
        assert hashlib.sha256(",".join(r["items"]).encode()).hexdigest() == digest and bool(r.spans) == contaminated
        assert r.text == texts[doc]
    clean = decontaminate.clean_documents(docs, bench, block_bytes=block_bytes)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i in got if not got[i].spans}
    spans = [(s.start, s.stop) for s in got[4].spans]
    assert decontaminate.remove_spans(texts[4], spans) == "x  y "
    assert decontaminate.scan(docs, bench.limit(0)).where("size(spans) > 0").count() == 0
    assert decontaminate.scan(docs.limit(0), bench).collect() == []


def test_windows_whose_hashes_clash_stay_apart(monkeypatch):
    monkeypatch.setattr(decontaminate, "_BASE", np.uint64(0))  # the hash is then the last word's id alone
    items = [("a", b"one two three"), ("b", b"two two three"), ("c", b"four three"), ("d", b"one two three")]
    index = decontaminate.Index(items, window=3)
    texts = [b"x one two three", b"two two three two two three", b"four three", b"three", None, b"one two", b"three one two three"]
    n, spans, owners = index.find(pa.array(texts, pa.binary()))
    assert n == [4, 6, 2, 1, 0, 2, 4]
    assert spans == [[(1, 4)], [(0, 3), (3, 6)], [(0, 2)], [], [], [], [(1, 4)]] or spans[1] == [(0, 6)]
    assert owners == [{"a", "d"}, {"b"}, {"c"}, set(), set(), set(), {"a", "d"}]


def test_a_benchmark_of_many_blocks_is_scanned_one_at_a_time(spark, frame, monkeypatch):
    items = [(i, f"item{i} " + " ".join(f"w{i}x{k}" for k in range(12))) for i in range(60)]
    texts = [None] + [f"start {items[i][1]} and {items[(i * 7) % 60][1]}" for i in range(30)]
    docs, bench = docs_of(frame, texts), frame(items, "item_id bigint, text string")
    alive, most = set(), [0]
    context, made = type(spark.sparkContext), spark.sparkContext.broadcast

    def counted(self, value):
        shared = made(value)
        if isinstance(value, decontaminate.Index):
            alive.add(id(shared))
            most[0] = max(most[0], len(alive))
            gone = shared.destroy
            shared.destroy = lambda *a: (alive.discard(id(shared)), gone(*a))
        return shared

    monkeypatch.setattr(context, "broadcast", counted)
    found = decontaminate.scan(docs, bench, block_bytes=600)
    got = {r.doc_id: r for r in found.collect()}
    assert most[0] <= 1 and len(decontaminate._blocks(bench.selectExpr("string(item_id) item", "text"), 600)) >= 20
    assert got[0]["items"] == [] and all(set(got[i + 1]["items"]) == {str(i), str(i * 7 % 60)} for i in range(30))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


# 10 Toxicity


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({" idiot ": 2.0, " scum": 1.5}, exceptions=("idiot proof",))
    for text in ("you IDIOT!", "1d10t", "ıdіоt", "i.d.i.o.t", "scumbags", "ｉｄｉｏｔ", "id​iot"):
        assert lexicon.hits(toxicity.fold(text)[0])[1] == 1, text
    for text in (None, "", "an idiot proof plan", "idiotic", "12 1 34", "obscum"):
        assert lexicon.hits(toxicity.fold(text)[0])[1] == 0, text
    assert lexicon.score("idiot") > lexicon.score("idiot " + "fine " * 500) > lexicon.score("") == lexicon.score(None)


@pytest.mark.parametrize("n", [5, 20, 29, 30, 31, 32, 33, 34, 35, 40, 500])
def test_chunks_of_every_length_are_folded_alike(n):
    lexicon = toxicity.Lexicon({" idiot ": 2.0, " scum": 1.5})
    hits = lambda text: lexicon.hits(toxicity.fold(text)[0])[1]
    assert hits("x-" * n + "idiot") == 1 and hits("fine," * n + "idiot") == 1 and hits("idiot/" * n) == n and hits("fine" * n + "idiot") == 0
    assert hits("-".join("idiot")) == 1 and hits(".".join("idiot") + "," + "fine," * n) == 1 and hits("word-" * n + "s.c.u.m") == 1
    assert toxicity.fold("fine," * n)[1] == n and toxicity.fold("fine " * n)[1] == n


def plain_hits(lexicon, text):
    """Weight and number of hits by looking for every entry at every place."""
    folded = toxicity.fold(text)[0]
    free = [(m.start(), m.start() + len(p) + 1) for p in lexicon.exceptions for m in re.finditer(f"(?={re.escape(f' {p} ')})", folded)]
    best = {}
    for entry, weight in lexicon.weights.items():
        for m in re.finditer(f"(?={re.escape(entry)})", folded):
            if len(entry) > best.get(m.start(), (0,))[0]:
                best[m.start()] = len(entry), weight
    kept = [w for s, (_, w) in best.items() if not any(a <= s < b for a, b in free)]
    return sum(kept), len(kept)


def test_toxicity_query_equals_a_plain_scan(spark, frame, tmp_path):
    rng = np.random.default_rng(13)
    pieces = ["idiot", "1d10t", "i.d.i.o.t", "moron", "scum", "trash", "trash can", "trash cans", "fine", "word", "clown", "clown fish", "x-idiot-y", "ok,scum", "St\u00fcpid", "stupid", "12", "!!", "\u0456diot"]
    texts = [None, "", "...", "idiot " * 3000, "trash can " * 3000 + "idiot"] + [" ".join(rng.choice(pieces, int(n))) for n in rng.integers(1, 60, 150)]
    frame([(i, t, "x", 3) for i, t in enumerate(texts)] + [(7, "another text of an id", "x", 3)], "doc_id bigint, text string, score string, predicted int").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int("idiot" in (t or ""))) for i, t in enumerate(texts) if i % 3] + [(None, 1, 1), (8, 0, None), (10, 1, 0)]
    frame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    lexicon, again = (toxicity.train(spark, str(tmp_path)) for _ in range(2))
    assert lexicon.weights == again.weights and lexicon.factors == again.factors and len(lexicon.weights) > 3
    got = toxicity.op10_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        if r.doc_id == 7:
            continue
        text = texts[r.doc_id]
        weight, n = plain_hits(lexicon, text)
        assert lexicon.hits(toxicity.fold(text)[0])[1] == n and abs(lexicon.hits(toxicity.fold(text)[0])[0] - weight) < 1e-6
        x = max(weight, 0.0)
        z = lexicon.factors[0] + lexicon.factors[1] * x / math.sqrt(toxicity.fold(text)[1] + 1) + lexicon.factors[2] * math.log1p(x)
        assert abs(r.score - 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))) < 1e-9 and r.predicted == int(r.score >= 0.5), text
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_learning_and_held_out_accuracy(spark, frame):
    rng = np.random.default_rng(6)
    clean = [f"{a}{b}" for a in ("ban", "tor", "mel", "pir") for b in ("ka", "lo", "nu", "si")]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 8 == 0
        words = list(rng.choice(clean, 60))
        if toxic:
            for _ in range(4):
                words.insert(int(rng.integers(60)), "grumf" + str(rng.choice(["a", "el", "isk", "or", "unt"])))
        rows.append((" ".join(words)))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (5000, None, None), (3, 1, 0)]
    docs = docs_of(frame, [*rows, None, ""])
    lexicon = toxicity.learn(docs, frame(labels, "doc_id bigint, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, lexicon).collect()}
    held = [i for i in range(1200) if toxicity.in_held_out(i)]
    assert all(got[i].predicted == labels[i][2] for i in held) and 0 <= got[1200].score < 0.5 and got[1201].score == got[1200].score
    assert toxicity.score(docs, lexicon).columns == [*(c for c in docs.columns if c != "score"), "score", "predicted"]
    none = toxicity.learn(docs, frame([], "doc_id bigint, toxic int"))
    assert none.score("you idiot") > 0.5 > none.score("you")
    assert toxicity.score(docs.limit(0), none).collect() == []
