"""The registered queries against their oracles, brute force and each other."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import chat_format, mixing, quality_fm, registry, url_filter

SF = "/root/testdata/sf0.001"


def oracle(sql):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    r = c.sql(sql)
    return r.columns, r.fetchall()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, name):
    columns, want = oracle(registry.ORACLES[name])
    got = [tuple(r) for r in registry.QUERIES[name](spark, SF).select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def documents():
    return sorted((r["doc_id"], r["text"] or "") for r in pq.read_table(f"{SF}/documents.parquet").to_pylist())


def spark_hash(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64(struct.pack("<q", v) if isinstance(v, int) else v, seed=h & (2**64 - 1)).intdigest()
    return h - 2**64 if h >= 2**63 else h


TOKENS = re.compile("(?<![^ \t-\r])[^ \t-\r]{1,24}+(?![^ \t-\r])|[^ \t-\raeiouAEIOU02468\x80-\U0010ffff]*+[aeiouAEIOU02468\x80-\U0010ffff]|[^ \t-\raeiouAEIOU02468\x80-\U0010ffff]++")


def syncmer_anchors(text, k=8, s=2):
    w = [spark_hash(x.encode()) for x in TOKENS.findall(text)]
    if len(w) < k:
        return [(0, spark_hash(*w) & 0xFFFFFFFF)] if w else []
    inner = [spark_hash(*w[i : i + s]) for i in range(len(w) - s + 1)]
    return [(i, spark_hash(*w[i : i + k]) & 0xFFFFFFFF) for i in range(len(w) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]


def fingerprint(found):
    return "".join(f"{p - q:x}{h:08x}" for (p, h), q in zip(found, [0, *[p for p, _ in found]], strict=False))


def near(a, b):
    linked = lambda x: {(h, q - p, g) for (p, h), (q, g) in zip(x, x[1:], strict=False)} if len(x) > 1 else {h for _, h in x}
    a, b = linked(a), linked(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_op4_equals_brute_force(spark):
    found = {r.doc_id: r for r in registry.QUERIES["op4_syncmer_fingerprints"](spark, SF).collect()}
    docs = documents()
    for i, (doc_id, text) in enumerate(docs):
        half, after = len(text) // 2, docs[(i + 1) % len(docs)][1]
        edited = text[: len(text) - half] + after[:half]
        own, changed, following = syncmer_anchors(text), syncmer_anchors(edited), syncmer_anchors(after)
        r = found[doc_id]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(own), fingerprint(changed))
        assert r.near_edited == pytest.approx(near(own, changed)) and r.near_next == pytest.approx(near(own, following))


def test_op8_equals_the_tokenizer_library(spark):
    import tiktoken

    from graphloom.llm import bpe

    path, pattern = bpe.public_files()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    found = {r.doc_id: r for r in registry.QUERIES["op8_byte_bpe"](spark, SF).collect()}
    for doc_id, text in documents():
        ids = enc.encode_ordinary(text)
        shown = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert (found[doc_id].n_tokens, found[doc_id].ids_sha256, found[doc_id].decoded_sha256) == (len(ids), shown, hashlib.sha256(text.encode()).hexdigest())


def escaped(text):
    out = text.replace("\\", "\\\\")
    for c in chat_format.CONTROL:
        out = out.replace(c, c[0] + "\\" + c[1:])
    return out


def cut(turns, budget=1024, history=256):
    """Windows of (turn, role, text) rows in order: each as ``(repeated turns, new turns)`` of (role, escaped text, tokens)."""
    told = [(escaped(r).replace("\n", chat_format.NEWLINE_IN_ROLE), escaped(t)) for _, r, t in turns]
    told = [(r, t, max(1, -(-len(t) // 4))) for r, t in told]
    system = 1 if turns[0][1] == "system" else 0
    room = max(1, budget - history - (told[0][2] if system else 0))
    starts, used = [0], 0
    for i, (_, _, n) in enumerate(told):
        if i and used + n > (budget if len(starts) == 1 else room):
            starts, used = [*starts, i], 0
        used += n
    out = []
    for begin, end in zip(starts, [*starts[1:], len(told)], strict=True):
        lead, recent, new, size = told[:system] if begin else [], [], told[begin:end], 0
        for i in range(begin - 1, system - 1, -1):
            size += told[i][2]
            if size > history:
                break
            recent.insert(0, told[i])
        if sum(n for _, _, n in lead + recent + new) > budget:
            recent = []
        out.append((lead + recent, new))
    return out


def test_op10_reads_back_every_conversation(spark):
    found = {r.conv_id: r for r in registry.QUERIES["op10_chat_format"](spark, SF).collect()}
    turns = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    assert set(found) == set(turns)
    for c, listed in turns.items():
        listed.sort()
        told, loss = "".join(f"{r}\n{t}\n" for _, r, t in listed), "".join(t for _, r, t in listed if r == "assistant")
        chars = sum(len(chat_format.OPEN + r + "\n" + t + chat_format.CLOSE) for repeated, new in cut(listed) for r, t, _ in repeated + new)
        want = (len(listed), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
        assert (found[c].n_turns, found[c].turns_sha256, found[c].loss_chars, found[c].loss_sha256, found[c].formatted_chars) == want


def brute_tree(paths, support=25, share=0.02):
    """``template`` of each ``(host, segments)`` with its number of pages."""
    tree, level = dict.fromkeys(paths, ()), 0
    open_paths = set(paths)
    while open_paths:
        nodes = collections.defaultdict(list)
        for p in open_paths:
            nodes[p[0], tree[p]].append(p)
        for (_, template), members in nodes.items():
            total = sum(paths[p] for p in members)
            of_child = collections.Counter()
            for p in members:
                if len(p[1]) > level:
                    of_child[p[1][level]] += paths[p]
            for p in members:
                if len(members) == 1 or len(p[1]) <= level:
                    tree[p] = template + p[1][level:]
                    open_paths.discard(p)
                else:
                    n = of_child[p[1][level]]
                    tree[p] = (*template, "*" if n < support and n < share * total else p[1][level])
        level += 1
    return tree


def brute_families(tree, labels, similar=2.0):
    """Template to family, and labelled pages ``(good, known)`` by family, for one host."""
    names = {t: t for t in set(tree.values())}
    nodes = collections.defaultdict(lambda: [0, 0])
    for p, t in tree.items():
        for k in (0, 1):
            nodes[t][k] += labels[p][k]
    for level in reversed(range(max(map(len, names), default=0))):
        kin = collections.defaultdict(list)
        for f in nodes:
            if len(f) > level and f[level] not in ("*", "+"):
                kin[(*f[:level], "+", *f[level + 1 :])].append(f)
        # A branch that is there already isn't kin: only literal segments are compared.
        moved = {}
        for branch, members in kin.items():
            if len(members) > 1:
                good, known = (sum(nodes[f][k] for f in members) for k in (0, 1))
                expected = (good + 1) / (known + 2)
                for f in members:
                    error = math.sqrt(expected * (1 - expected) / max(nodes[f][1], 1))
                    if nodes[f][1] == 0 or abs(nodes[f][0] / nodes[f][1] - expected) <= similar * error:
                        moved[f] = branch
        names = {t: moved.get(f, f) for t, f in names.items()}
        after = collections.defaultdict(lambda: [0, 0])
        for f, (good, known) in nodes.items():
            after[moved.get(f, f)][0] += good
            after[moved.get(f, f)][1] += known
        nodes = after
    return names, nodes


def brute_url_verdicts(rows, rules):
    """``(host, path, rule, verdict, template, purity)`` by key of ``(key, url, good)`` rows."""
    seen = {}
    for key, url, good in rows:
        m = re.match(r"(?s).*?://([^/?#]*)(/[^?#]*)?", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2] or "") if m else ("", "")
        variable = r"(?:[0-9]+|[0-9a-fA-F]{8,}|[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?|[0-9a-fA-F]{8}-[0-9a-fA-F-]{27})(?:\.[A-Za-z0-9]{1,5})?"
        seen[key] = (host, path, tuple("*" if re.fullmatch(variable, x) else x for x in path.split("/") if x), good)
    paths, labels = collections.Counter(), collections.defaultdict(lambda: [0, 0])
    for host, _, segs, good in seen.values():
        paths[host, segs] += 1
        labels[host, segs][0] += good == 1
        labels[host, segs][1] += good is not None
    tree = brute_tree(paths)
    by_host = collections.defaultdict(dict)
    for p, t in tree.items():
        by_host[p[0]][p] = t
    merged = {h: brute_families(t, labels) for h, t in by_host.items()}
    all_good, all_known = (sum(x[k] for x in labels.values()) for k in (0, 1))
    overall, out = min(1.0, (all_good + 1) / (all_known + 1)), {}
    for key, (host, path, segs, _) in seen.items():
        names, nodes = merged[host]
        good, known = (sum(x[k] for x in nodes.values()) for k in (0, 1))
        base = (good + 20 * overall) / (known + 20)
        template = tree[host, segs]
        purity = (nodes[names[template]][0] + 20 * base) / (nodes[names[template]][1] + 20)
        fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        rule = min(fits, key=lambda r: (-len(r), r), default=None)
        out[key] = (host, path, rule, rules[rule] if rule else "block" if purity < 0.5 else "allow", "/".join(template), purity)
    return out


def compare_urls(rows, want):
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict, r.template) == want[r.page_id][:5] and r.purity == pytest.approx(want[r.page_id][5])
    assert len(rows) == len(want)


def test_op1_equals_brute_force(spark):
    quality = collections.defaultdict(list)
    for r in pq.read_table(f"{SF}/labels.parquet").to_pylist():
        if r["doc_id"] is not None and r["quality"] is not None:
            quality[r["doc_id"]].append(r["quality"])
    rows = []
    for r in pq.read_table(f"{SF}/pages.parquet").to_pylist():
        m = re.search(r"/([0-9]+)(?:[./?#].*)?$", r["url"] or "")
        rows.append((r["page_id"], r["url"], min(quality[int(m[1])]) if m and quality.get(int(m[1])) else None))
    compare_urls(registry.QUERIES["op1_url_filter"](spark, SF).collect(), brute_url_verdicts(rows, url_filter.RULES))


def test_url_trees_of_any_depth_equal_brute_force(spark):
    """Deep and uneven paths, hosts of one page and of many, chains, repeated rows, a very long url."""
    rng, rows = random.Random(3), []
    for i in range(1500):
        host = rng.choice(["a.com", "a.com", "a.com", "b.org", f"h{i}.net"])
        depth = rng.randrange(7)
        segs = [rng.choice(["en", "de", "x", "spam", "news", f"v{rng.randrange(400)}", str(rng.randrange(99))]) for _ in range(depth)]
        good = rng.choice([None, int("spam" not in segs), int("spam" not in segs), rng.randrange(2)])
        rows.append((i, f"http://{host}/{'/'.join(segs)}", good))
    rows += [(2000 + k, "http://a.com/" + "/".join(["deep"] * 300 + ["end"] * k), 0) for k in range(2)]
    rows += [(3000 + k, u, None) for k, u in enumerate([None, "", "no host", "http://", "http://a.com/" + "y" * 50_000, rows[0][1], rows[0][1]])]
    df = spark.createDataFrame(rows, "page_id long, url string, good int").withColumns({"seg": F.lit(1), "n": F.lit("clash"), "host": F.lit("clash")})
    rules = {"com/en/": "block", "a.com/": "allow", "org/": "block"}
    compare_urls(url_filter.filtered(df, rules).collect(), brute_url_verdicts(rows, rules))


def test_op2_equals_raking_by_hand(spark):
    """Given the topics, every probability and draw follows."""
    rows = registry.QUERIES["op2_mixing"](spark, SF).collect()
    texts = {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    assert len(rows) == len(texts)
    cells = collections.Counter()
    for r in rows:
        assert (r.source, r.lang, r.tokens) == (texts[r.doc_id]["source"], texts[r.doc_id]["lang"], len((texts[r.doc_id]["text"] or "").encode().split()))
        cells[r.source, r.lang, r.topic] += r.tokens
    total, weight, want = sum(cells.values()), {c: float(n) for c, n in cells.items()}, []
    for k in range(3):
        seen = collections.Counter()
        for c, n in cells.items():
            seen[c[k]] += n
        power = {v: (n / total) ** mixing.TEMPER for v, n in seen.items()}
        want.append({v: total * p / sum(power.values()) for v, p in power.items()})
    for _ in range(300):
        for k in range(3):
            now = collections.Counter()
            for c, x in weight.items():
                now[c[k]] += x
            weight = {c: x * want[k][c[k]] / now[c[k]] if now[c[k]] else x for c, x in weight.items()}
    lift = {c: weight[c] / n if n else 1.0 for c, n in cells.items()}
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * min(1.0, mid * lift[c]) for c, n in cells.items()) < 0.5 * total else (low, mid)
    for r in rows:
        c = (r.source, r.lang, r.topic)
        drawn = int(hashlib.sha256(f"mix:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        assert r.lift == pytest.approx(lift[c], rel=1e-4) and r.probability == pytest.approx(min(1.0, high * lift[c]), rel=2e-2) and r.sampled == (drawn < r.probability)


def test_op5_equals_the_pairwise_sum(spark):
    """Fitted and scored anew without Spark; the score's pairs are summed one by one for some texts."""
    docs = documents()
    texts, known = dict(docs), []
    for r in pq.read_table(f"{SF}/labels.parquet").to_pylist():
        if r["doc_id"] in texts and r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            known.append((r["doc_id"], *quality_fm.features(texts[r["doc_id"]]), r["quality"]))
    known.sort(key=lambda x: (x[0], x[1].astype(np.int32).tobytes(), x[3]))
    m = quality_fm.fit([x[1:] for x in known])
    w, v = m.w.astype(np.float32).astype(float), m.v.astype(np.float32).astype(float)
    rows = registry.QUERIES["op5_quality_fm"](spark, SF).collect()
    assert len(rows) == len(docs)
    for k, r in enumerate(rows):
        p, x = quality_fm.features(texts[r.doc_id])
        if k % 10 == 0 and len(p) < 400:
            pairs = sum(float(v[p[i]] @ v[p[j]]) * x[i] * x[j] for i in range(len(p)) for j in range(i))
        else:
            pairs = 0.5 * float(((v[p] * x[:, None]).sum(axis=0) ** 2 - ((v[p] * x[:, None]) ** 2).sum(axis=0)).sum())
        assert r.score == pytest.approx(1 / (1 + math.exp(-(m.bias + float(w[p] @ x) + pairs))), abs=1e-4)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3)


def test_pipeline_keeps_what_its_stages_keep(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "encode"]
    out = corpus_pipeline.run(spark, SF)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    texts = dict(documents())
    assert ids and len(ids) == len(set(ids)) and len({texts[i] for i in ids}) == len(ids)


def test_pipeline_stages_on_edge_cases(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names, an empty table."""
    import corpus_pipeline

    near = " ".join(f"word{i}" for i in range(200))
    rows = [(i, t, l, s) for i, (t, l, s) in enumerate([(None, None, None), ("", "en", "s"), ("plain text here", "en", None), ("plain text here", None, "s"), ("long " * 40_000, "en", "s"), (near, "en", "s"), (near + " more", "en", "s"), ("\x00 odd \u2028 漢字", "zh", "s")])]
    rows += [rows[2], (None, "no id", "en", "s"), (None, "no id", "en", "s"), (None, near, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"n_chars": F.length("text").cast("long"), "score": F.lit("x"), "may_go": F.lit(1), "id": F.lit(2), "digest": F.lit("y"), "topic": F.lit(3)})
    labels = spark.createDataFrame([(2, 1, 0), (5, 0, 0), (None, 1, 1), (7, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, str(tmp_path)).collect()
            if given is not docs:
                assert out == []
                continue
            ids = collections.Counter(r["doc_id"] for r in out)
            if name == "quality":
                assert stage(spark, docs, str(tmp_path)).columns == docs.columns and ids[2] in (0, 2) and ids[2] // 2 == ids[3]
            elif name == "exact":
                assert ids == collections.Counter([1, 3, 4, 5, 6, 7, None])
                assert sum(r["text"] == "no id" for r in out) == 1 and {r["lang"] for r in out if r["doc_id"] == 3} == {None}
            elif name == "near":
                assert ids == collections.Counter([0, 1, 2, 2, 4, 5, 7, None, None, None])
            elif name == "mix":
                assert stage(spark, docs, str(tmp_path)).columns == docs.columns and ids[2] in (0, 2) and set(ids) <= {r[0] for r in rows}
            else:
                assert len(out) == len(rows) and {r["n_tokens"] for r in out if r["doc_id"] in (0, 1)} == {0} and all(r["n_tokens"] == len(r["ids"]) for r in out)
