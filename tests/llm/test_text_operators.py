"""Quality, secrets, byte BPE and packing against brute force, SQL and the public libraries."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import regex
import tiktoken
from conftest import documents, edge_rows, words
from tokenizers import Tokenizer

from tideline.llm import bpe, packing, quality, queries, secrets

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def same_rows(a, b):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)


def by_sql(df, sql):
    con = duckdb.connect()
    con.register("pd_documents", df.select("doc_id", "text", "lang", "source").toPandas().astype({"doc_id": "Int64"}))
    con.execute("create table documents as select doc_id::bigint doc_id, text::varchar as text, lang::varchar lang, source::varchar source from pd_documents")
    return con.sql(sql)


@pytest.mark.parametrize("name", ["op1_quality", "op8_secrets"])
def test_native_operators_match_their_sql(spark, data, edges, empty, name):
    run = quality.verdicts if name == "op1_quality" else secrets.scan
    for docs in (edges, empty, spark.read.parquet(f"{data}/documents.parquet")):
        # DuckDB's strings end at a zero character
        docs = docs.where("text is null or instr(text, char(0)) = 0")
        got, want = run(docs), by_sql(docs, queries.oracle_sql()[name])
        same_rows(got.select(*sorted(got.columns)).collect(), want.project(", ".join(f'"{c}"' for c in sorted(got.columns))).fetchall())


def base_counts(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(zip(found, found[1:], found[2:], strict=False))
    covered = {i + j for i, w in enumerate(zip(found, found[1:], found[2:], strict=False)) if seen[w] > 1 for j in range(3)}
    failed = len(found) < 50 or 100 * len(covered) > 50 * len(found)
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def test_quality_base_counts_by_brute_force(edges):
    got = quality.verdicts(edges).collect()
    same_rows([tuple(r)[:7] for r in got], [(r[0], *base_counts(r[1])) for r in edge_rows()])
    assert not any(r.kept for r in got if r.base_failed)


def test_quality_fences_drop_outliers_of_their_own_group(spark):
    rows = [(i, words(i, 120), "en", "plain") for i in range(150)] + [(1000 + i, " # ".join(words(i, 120).split()), "en", "code") for i in range(150)] + [(5000, " # ".join(words(7, 120).split()), "en", "plain")]
    kept = {r.doc_id for r in quality.filter_documents(documents(spark, rows)).collect()}
    assert 5000 not in kept and len(kept & set(range(150))) >= 148 and len(kept & set(range(1000, 1150))) >= 148


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    t = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_secret_spans_by_brute_force(spark, data, edges):
    for docs in (edges, spark.read.parquet(f"{data}/documents.parquet")):
        texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        want = []
        for doc_id, text in texts:
            spans = base_spans(text)
            line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
            want.append((doc_id, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(line.encode()).hexdigest()))
        got = secrets.scan(docs).collect()
        same_rows([tuple(r)[:5] for r in got], want)
        for r in got:
            kinds = [x.split(":")[0] for x in r.spans.split(",") if x]
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))


def test_secret_ownership_separates_examples_from_live_values(spark):
    live, shared = "Zx9" + "q7Wm" * 8, "Ex4" + "k2Lp" * 8
    rows = [(1, f"key {live} end", "en", "owner1"), (2, f"key {live} again", "en", "owner1"), *((10 + i, f"doc {shared} end", "en", f"owner{i}") for i in range(5))]
    got = {r.doc_id: r.spans for r in secrets.scan(documents(spark, rows)).collect()}
    assert got[1] == f"live:4:{4 + len(live)}" == got[2] and all(got[10 + i] == "" for i in range(5))
    clean = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(documents(spark, rows)).collect()}
    assert clean[1] == ("key [SECRET] end", 16) and clean[10][0] == rows[2][1]


def test_redaction_keeps_rows_columns_and_other_text(edges):
    out = secrets.redact(edges)
    assert out.columns == edges.columns and out.count() == edges.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[12].startswith("[SECRET] and token: 'abc' and [SECRET] [SECRET]") and texts[13] == words(5, 300) and texts[1] is None


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["  two  spaces \n\n\n x", "tabs\t\tand nbsp　wide", "I'm we'LL 'S don't", "123456 ٣٤ ½ Ⅷ", "क्षि กำ", "한국어 日本語", "\x1c\x1d \x85   ​", "\U0001f468‍\U0001f469‍\U0001f467 !!!???", "<|endoftext|> <|startoftext|>", "trailing   ", "\n", " ", "a\r\nb\r\n\r\nc", "İı ẞ ﬁ"]


def test_byte_bpe_matches_tiktoken_and_decodes(spark, data, edges, tik):
    odd = documents(spark, list(enumerate(ODD)))
    for docs in (edges, odd, spark.read.parquet(f"{data}/documents.parquet")):
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = tik.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        same_rows(bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect(), want)


def test_byte_bpe_offsets_and_round_trip(spark, edges):
    docs = documents(spark, list(enumerate(ODD)))
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    for r in encoded.collect():
        text = ODD[r.doc_id]
        assert all(0 <= a < b <= len(text) for a, b in zip(r.starts, r.ends, strict=True)) and list(r.starts) == sorted(r.starts)
        assert r.starts[:1] in ([], [0]) and (not r.ends or max(r.ends) == len(text))
    assert {r.doc_id: r.text for r in bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()} == dict(enumerate(ODD))
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    ids, _, _ = codec.encode("\U0001f9a5")
    assert len(ids) > 1 and codec.decode(ids) == "\U0001f9a5" and codec.decode(ids[:1]) == "�"
    assert regex.findall(public_tokenizers.PATTERN, "") == []


def brute_pieces(rows, length=2048):
    tok = Tokenizer.from_file(WORDS)
    out = Counter()
    for doc_id, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        out[doc_id, len(ids)] += 1
    return tok, out


def test_packing_ids_pieces_and_sequences(spark, data, edges):
    odd = documents(spark, list(enumerate(ODD)))
    tok = Tokenizer.from_file(WORDS)
    for docs in (edges, odd, spark.read.parquet(f"{data}/documents.parquet")):
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
            for at in range(0, len(ids), 2048):
                part = ids[at : at + 2048]
                want[r.doc_id, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)), len(ids)] += 1
        rows = packing.pack(docs, WORDS).collect()
        assert Counter(tuple(r)[:5] for r in rows) == want
        check_sequences(rows)


def check_sequences(rows, length=2048, slack=1.02):
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    total = sum(r.length for r in rows)
    assert sorted(used) == list(range(len(used))) and len(used) <= slack * total / length + 1


def test_packing_patterns_place_every_length_once():
    histogram = {2048: 3, 1500: 4, 700: 2, 548: 5, 100: 40, 1: 9}
    found = packing.patterns(histogram)
    placed = Counter()
    for n, pack in found:
        assert sum(pack) <= 2048
        for size in pack:
            placed[size] += n
    assert placed == histogram


def test_empty_tables(empty):
    for df in (quality.verdicts(empty), secrets.scan(empty), bpe.digests(empty, RANKS, public_tokenizers.PATTERN), packing.pack(empty, WORDS), secrets.redact(empty), quality.filter_documents(empty)):
        assert df.count() == 0
