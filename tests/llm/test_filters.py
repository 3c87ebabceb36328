import base64
import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import tiktoken
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from berth.llm import mixing, quality_rules, queries, substring_dedup
from tests.llm.conftest import LONG, SF, frame
from tests.llm.test_joins import plain_join


def sql(name, sf=SF):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    return con.sql(queries.ORACLES[name])


@pytest.mark.parametrize("name", ["op1_line_dedup", "op5_pareto_mix"])
def test_queries_are_their_sql(spark, name):
    out, want = queries.QUERIES[name](spark, SF), sql(name)
    assert sorted(map(tuple, out.select(*want.columns).collect())) == sorted(want.fetchall())


def test_passages():
    line = " ".join(["long"] * 20)
    text = f"head\n{line}\n\n{line}\nshort\n{line}\nend"
    kept, n, removed, starts, ends = substring_dedup.passages(text, [1, 3, 5, 6], 30)
    assert (kept, n, removed) == (f"head\n\nshort\n{line}\nend", 6, 2)
    assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == [line, line]


def test_passages_go_from_all_but_the_earliest(spark, edge, empty):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(3, f"mine alone\n{passage}\nmore of it", "en", "a"), (1, f"own start\n  {passage.upper()} \nown end", "en", "b"), (2, f"{passage}\n{passage}", "en", "b"), (4, "short line\nmine alone", "en", "c")]
    out = {r["doc_id"]: r["text"] for r in substring_dedup.remove(frame(spark, rows), unit="line").collect()}
    assert out == {1: rows[1][1], 2: "", 3: "mine alone\nmore of it", 4: rows[3][1]}
    kept = substring_dedup.remove(edge, unit="line")
    assert kept.columns == edge.columns and kept.count() == edge.count()
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert (2, None) in got and (3, "") in got and (5, LONG) in got and (6, "") in got
    assert [t for i, t in got if i == 1] == [rows_of(edge, 1)] * 2  # repeated rows share their rank
    assert substring_dedup.report(empty, unit="line").count() == 0


def plain_windows(docs):
    """All windows of all texts compared as words; of NEAR successive ones the smallest digest is a unit."""
    found, first = {}, {}
    for key, text in docs:
        words = ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        grams = [tuple(words[i : i + 12]) for i in range(len(words) - 11)]
        order = [int(np.uint64(substring_dedup.windows([w.encode() for w in g], substring_dedup._Numbers())[0][0])) for g in grams]
        units = {min(range(i, min(i + 12, len(grams))), key=lambda k: (order[k], k)) for i in range(max(1, len(grams) - 11))} if grams else set()
        found[key] = {p: grams[p] for p in sorted(units)}
        for p, g in found[key].items():
            first.setdefault(g, (key, p))
    out = {}
    for key, text in docs:
        covered = {w for p, g in found[key].items() if first[g] != (key, p) for w in range(p, p + 12)}
        spans, runs = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")], []
        for w in sorted(covered):
            if runs and runs[-1][1] == w:
                runs[-1][1] = w + 1
            else:
                runs.append([w, w + 1])
        kept, at = "", 0
        for a, b in runs:
            if b - a >= 28:
                kept, at = kept + text[at : spans[a][0]], spans[b - 1][1]
        out[key] = None if text is None else kept + text[at:]
    return out


def test_windows_are_their_plain_version(spark, rules_sf):
    docs = sorted((r["doc_id"], r["text"]) for r in rules_sf.collect())
    want = plain_windows(docs)
    out = {r["doc_id"]: r for r in queries.QUERIES["op1_substring_dedup"](spark, SF).collect()}
    assert {i: r["text"] for i, r in out.items()} == want and any(want[i] != text for i, text in docs)
    assert all(r["changed"] == (r["text"] != text) for (i, text) in docs for r in [out[i]])


@pytest.mark.parametrize("words", [51, 60, 120])
def test_passages_anywhere_go(spark, words):
    rng, docs = np.random.default_rng(words), []
    own = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    planted = {}
    for i in range(0, 200, 2):
        passage, breaks = own(words), rng.integers(3, 20, 200)
        lines = [passage[a:b] for a, b in zip(np.cumsum([0, *breaks]), np.cumsum(breaks), strict=False) if a < words]
        docs += [(i, " ".join(own(40) + passage + own(30))), (i + 1, " ".join(own(25)) + " " + "\n".join(map(" ".join, lines)).upper() + " " + " ".join(own(35)))]
        planted[i + 1] = (set(passage), docs[-1][1].split())
    out = {r["doc_id"]: r["text"] for r in substring_dedup.remove(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(out[i] == text for i, text in docs if i % 2 == 0)
    for i, (passage, whole) in planted.items():
        left = out[i].split()
        assert len(whole) - len(left) >= words - 22 and [w for w in whole if w.lower() not in passage] == [w for w in left if w.lower() not in passage]


def test_window_units_on_edges(spark, edge, empty):
    kept = substring_dedup.remove(edge)
    assert kept.columns == edge.columns and kept.count() == edge.count()
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert (2, None) in got and (3, "") in got and (4, " \n\t ") in got
    assert [t for i, t in got if i == 1] == [rows_of(edge, 1)] * 2
    assert substring_dedup.report(empty).count() == 0
    names = {c: F.lit(7) for c in ("__key", "__hash", "__key_", "__hash_", "__again", "__cut", "__rank", "__d1")}
    clash = substring_dedup.remove(edge.withColumns(names))
    assert clash.columns == [*edge.columns, *names] and all(set(r[len(edge.columns):]) == {7} for r in clash.collect())


def test_passages_inside_lines_go(spark, edge, empty):
    """One stands inside a longer line, one is broken differently; line units see neither."""
    passage = [f"p{i}" for i in range(80)]
    own = {i: [f"own{i}x{k}" for k in range(40)] for i in (1, 2, 3)}
    texts = {1: " ".join(own[1] + passage), 2: " ".join(own[2][:20] + passage + own[2][20:]), 3: "\n".join([*own[3], *(" ".join(passage[i : i + 7]) for i in range(0, 80, 7))])}
    docs = frame(spark, [(i, t, "en", "a") for i, t in texts.items()])
    assert {r["doc_id"]: r["text"] for r in substring_dedup.remove(docs, unit="line").collect()} == texts
    out = {r["doc_id"]: r for r in substring_dedup.report(docs, unit="piece").collect()}
    assert out[1]["text"] == texts[1] and out[1]["removed"] == ""
    for i in (2, 3):
        (start, end), = [map(int, span.split(":")) for span in out[i]["removed"].split(",")]
        gone = texts[i][start:end].split()
        assert set(gone) <= set(passage) and len(gone) >= 55 and out[i]["text"] == texts[i][:start] + texts[i][end:]
    kept = substring_dedup.remove(edge, unit="piece")
    assert kept.columns == edge.columns and kept.count() == edge.count()
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert (2, None) in got and (3, "") in got and (4, " \n\t ") in got
    assert [t for i, t in got if i == 1] == [rows_of(edge, 1)] * 2
    assert substring_dedup.report(empty, unit="piece").count() == 0


def test_pieces_are_their_plain_version(spark, rules_sf):
    rows = sorted((r["doc_id"], r["text"]) for r in rules_sf.collect())
    first, want = {}, {}
    for i, text in rows:
        words, at, again = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)), 0, []
        for p, end in enumerate(substring_dedup.piece_ends([w.encode() for w in words], substring_dedup._Ends())):
            if first.setdefault(tuple(words[at:end]), (i, p)) != (i, p):
                again.append(p)
            at = end
        want[i] = substring_dedup.piece_passages(text, again)[0]
    assert {r["doc_id"]: r["text"] for r in substring_dedup.remove(rules_sf, unit="piece").collect()} == want
    assert any(want[i] != text for i, text in rows)


def rows_of(df, key):
    return next(r["text"] for r in df.collect() if r["doc_id"] == key)


def test_mix_meets_its_targets(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.amounts(docs).collect()
    taken, target = Counter(), {}
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        key = docs_source(docs)[r["doc_id"]]
        taken[key] += r["taken"]
        target[key] = (r["target"], r["source_size"])
    assert all(abs(taken[k] - t) <= 0.02 * t and t <= 2 * s for k, (t, s) in target.items())
    assert sum(t for t, _ in target.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    again = mixing.amounts(docs.repartition(7, "text")).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    out = mixing.mix(edge)
    amounts = mixing.amounts(edge).collect()
    assert out.columns == edge.columns and out.count() == sum(r["copies"] for r in amounts)
    assert len(amounts) == edge.count() and {r["size"] for r in amounts if r["doc_id"] in (2, 3, 4)} == {0}
    assert mixing.mix(empty).count() == 0 and mixing.amounts(empty).count() == 0


_sources = {}


def docs_source(docs):
    if not _sources:
        _sources.update({r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()})
    return _sources


def test_appeal_moves_the_copies(spark):
    rows = [(i, "one two three four", float(i % 4), "s") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, appeal double, source string")
    out = mixing.amounts(docs, appeal="appeal", share=0.5, weights=(1,)).collect()
    mean = {k: np.mean([r["copies"] for r in out if r["doc_id"] % 4 == k]) for k in range(4)}
    assert mean[0] == 0 and mean[1] < mean[2] < mean[3] and sum(r["taken"] for r in out) == 800


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(line in lines[:i] for i, line in enumerate(lines)), len(covered)


def test_counts(edge_rows):
    texts = [t for _, t, _, _ in edge_rows] + ["a b c a b c a b", "x\n\x1c\nx\n\x1c\n \nx", "#a\t$$ <b>\x0b|", "a a a a", "a b c"]
    for text in texts:
        if text != LONG:
            assert quality_rules.statistics(text)[:5] == plain_statistics(text)


def plain_verdicts(rows):
    """Kept of (lang, source, text): all groups step by step in numpy, moments as matrices of (1, x)."""
    found = [plain_statistics(t) for _, _, t in rows]
    x, n = np.array([plain_vector(t) for _, _, t in rows]), np.array([f[0] for f in found])
    failed = (n < 50) | (100 * np.array([f[4] for f in found]) > 50 * n)
    floors = np.array([0.05, 0.05, 0.15, 0.12, 0.05, 0.04, 0.06])
    members = {}
    for i, (lang, source, _) in enumerate(rows):
        for key in [] if failed[i] else [(), (lang,), (lang, source)]:
            members.setdefault(key, []).append(i)
    order = sorted(members, key=len)
    inner = lambda v, p: np.sort(v, axis=0)[math.ceil(p * len(v)) - 1]
    log = lambda part, fit: np.floor(32 * np.log2(np.maximum(2.0**-20, np.einsum("ij,jk,ik->i", part - fit[0], fit[1], part - fit[0]))))
    fits, size = {}, {}
    for key in order:
        part = np.rint(512 * x[members[key]])
        middle, quarter = inner(part, 0.5), inner(part, 0.25)
        wide = np.diag((1.4826 * inner(abs(part - middle), 0.5) / 512 + floors) ** -2)
        fits[key] = [(middle / 512, wide), (middle / 512, np.diag(floors**-2)), (quarter / 512, wide)]
        size[key] = [np.inf] * 3
    for _ in range(10):
        fall, total = -np.inf, {}
        for key in order:
            part = x[members[key]]
            for k in range(3):
                bins = log(part, fits[key][k])
                core = np.insert(part[bins <= inner(bins, 0.5)], 0, 1, axis=1)
                moments = core.T @ core
                if key:
                    wider = total[key[:-1], k]
                    moments = moments + 200 * wider / wider[0, 0]
                total[key, k] = moments
                mean = moments[0, 1:] / moments[0, 0]
                cov = 1.695 * (moments[1:, 1:] / moments[0, 0] - np.outer(mean, mean)) + np.diag(floors**2)
                fits[key][k], now = (mean, np.linalg.inv(cov)), np.linalg.slogdet(cov)[1]
                fall, size[key][k] = max(fall, size[key][k] - now), now
        if fall <= 1e-4:
            break
    centres, kept = {}, []
    for key in order:
        bins = log(x[members[key]], fits[key][int(np.argmin(size[key]))])
        half, quarter = (2 ** ((inner(bins, p) + 1) / 96) for p in (0.5, 0.25))
        centres[key] = np.array([half, (half - quarter) / 0.6745])
        if key:
            centres[key] = (len(bins) * centres[key] + 200 * centres[key[:-1]]) / (len(bins) + 200)
    for i, (lang, source, _) in enumerate(rows):
        if failed[i]:
            kept.append(False)
            continue
        key = lang, source
        behind = min(len(members[()]), len(members[key]) + 200)
        limit = max(24.32, (centres[key] @ [1, 5]) ** 3) * (behind**2 - 1) / (behind * (behind - 7)) if behind > 7 else np.inf
        mean, precision = fits[key][int(np.argmin(size[key]))]
        kept.append(bool((x[i] - mean) @ precision @ (x[i] - mean) <= limit))
    return kept


def plain_vector(text):
    n, chars, symbols, dup_lines, repeated = plain_statistics(text)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) for line in (text or "").split("\n"))
    part = lambda some, whole: math.asin(math.sqrt(min(1, some / whole))) if whole else 0.0
    marks = sum(c.isascii() and c.isprintable() and not c.isalnum() and c != " " for c in text or "")
    capitals, digits = (sum(c.isascii() and test(c) for c in text or "") for test in (str.isupper, str.isdigit))
    return [math.log(chars / n) if n else 0.0, part(symbols, chars), part(dup_lines, lines), part(repeated, n), part(capitals, chars), part(marks, chars), part(digits, chars)]


def test_rules_are_brute_force(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "lang", "source", "text").collect()
    want = plain_verdicts([(r["lang"], r["source"], r["text"]) for r in rows])
    got = {r["doc_id"]: r for r in quality_rules.assess(docs).collect()}
    assert [got[r["doc_id"]]["kept"] for r in rows] == want
    assert sum(want) < len(want) and got[rows[0]["doc_id"]]["n_words"] == plain_statistics(rows[0]["text"])[0]
    out = quality_rules.assess(edge).collect()
    assert len(out) == edge.count() and not any(r["kept"] for r in out if r["doc_id"] in (2, 3, 4, 7))
    kept = quality_rules.filter_documents(edge)
    assert kept.columns == edge.columns and [r["doc_id"] for r in kept.collect()].count(1) == 2
    assert quality_rules.assess(empty).count() == 0 and quality_rules.filter_documents(empty).count() == 0


def test_junk_of_two_fifths_is_rejected(spark):
    """A core of three quarters takes such junk for the bulk."""
    rng = np.random.default_rng(3)
    words = lambda some: " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(some)) + "."
    clean = [words(rng.integers(60, 90)) for _ in range(180)]
    junk = [" ".join(w + "#$%"[: rng.integers(1, 4)] for w in words(70).split()) for _ in range(120)]
    rows = [(i, t, "en", "hot") for i, t in enumerate(clean + junk)]
    kept = {r["doc_id"] for r in quality_rules.filter_documents(frame(spark, rows)).collect()}
    assert kept == set(range(180))


def test_groups_of_any_size_have_a_limit(spark):
    """Few symbols in a large group, in a small one and in one of a single row; clean rows stay, also alone in their group."""
    rng = np.random.default_rng(5)
    words = lambda some: [rng.choice(list("abcdefghij"), rng.integers(2, 9)).tolist() for _ in range(some)]
    clean = [" ".join(map("".join, words(rng.integers(60, 90)))) + "." for _ in range(330)]
    junk = [" ".join("".join(w) + "#" * (rng.random() < 0.4) for w in words(rng.integers(60, 90))) + "." for _ in range(40)]
    sources = ["big"] * 300 + ["few"] * 20 + [f"one{i}" for i in range(10)] + ["big"] * 30 + ["few"] * 6 + [f"own{i}" for i in range(4)]
    rows = [(i, t, "en", s) for i, (t, s) in enumerate(zip(clean + junk, sources, strict=True))]
    assert plain_verdicts([(la, s, t) for _, t, la, s in rows]) == [True] * 330 + [False] * 40
    assert {r["doc_id"] for r in quality_rules.filter_documents(frame(spark, rows)).collect()} == set(range(330))


def test_pipeline_is_its_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    kept = plain_verdicts([(r["lang"], r["source"], r["text"]) for r in rows.values()])
    rows = {i: r for (i, r), k in zip(rows.items(), kept, strict=True) if k}
    rows = {i: rows[i] for i, _, c in plain_join([(i, r["text"]) for i, r in rows.items()]) if i == c}
    cut = plain_windows([(i, rows[i]["text"]) for i in sorted(rows)])
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, cut[i], rows[i]["source"]) for i in rows])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in con.sql(mixing.SQL).select(duckdb.ColumnExpression("doc_id"), duckdb.ColumnExpression("copies")).fetchall():
        want += [(r[0], rows[r[0]]["lang"], rows[r[0]]["source"], np.array(plain.encode_ordinary(cut[r[0]]), "<u4").tobytes())] * r[1]
    out = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["lang"], r["source"], bytes(r["ids"])) for r in out.collect()) == sorted(want)
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in out.collect())


def test_ids_of_the_last_stage_lead_back(spark, edge):
    short = edge.where("doc_id not in (5, 6)")
    out = corpus_pipeline.token_ids(spark, short, SF).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(r["decoded_sha256"] for r in out) == sorted(digest(r["text"]) for r in short.collect())


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_any_rows(spark, edge, empty, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, edge, SF)
    out.collect()
    if k + 1 < len(corpus_pipeline.STAGES):
        assert out.columns == edge.columns
    assert stage(spark, empty, SF).count() == 0
