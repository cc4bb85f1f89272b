"""Alignment, line de-duplication and repair of conversations against plain Python, and their edge cases."""

import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tielace.llm import align, lines, turns
from tielace.llm.base import Scratch
from tielace.llm.tokens import public_file

SMALL = "/root/testdata/sf0.001"
A, B = public_file("byte_bpe_50k.json"), public_file("piece_bpe_32k.model")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


# 11


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, {i: t for t, i in a.get_vocab().items()}, sentencepiece.SentencePieceProcessor(model_file=B), align.byte_letters()


def plain_groups(tokenizers, text):
    """Groups of both tokenizers' ids, by the byte offsets of whole texts' tokens."""
    a, names, b, letters = tokenizers
    if not text:
        return []
    raw = (" " + text).encode()
    own_a = [(i, bytes(letters[c] for c in names[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
    own_b = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        own_b.append((i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()))
    if b"".join(x for _, x in own_a) != raw or b"".join(x for _, x in own_b) != raw:
        return []
    ends = [list(itertools.accumulate(len(x) for _, x in own)) for own in (own_a, own_b)]
    groups, both, at = [], set(ends[1]), [0, 0]
    for cut in [e for e in ends[0] if e in both]:
        own = []
        for side, tokens in enumerate((own_a, own_b)):
            start = at[side]
            while at[side] < len(tokens) and ends[side][at[side]] <= cut:
                at[side] += 1
            own.append([i for i, _ in tokens[start : at[side]]])
        groups.append(tuple(own))
    return groups


def plain_alignment(tokenizers, rows):
    groups = [plain_groups(tokenizers, t) for _, t in rows]
    links = [[(x, y) for g in own for x in g[0] for y in g[1]] for own in groups]
    docs = Counter(p for own in links for p in set(own))
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    out = []
    for (doc_id, _), own, linked in zip(rows, groups, links, strict=True):
        text = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in own)
        best = sum(docs[p] == most[p[0]] for p in linked)
        digest = hashlib.sha256(text.encode()).hexdigest() if own else ""
        out.append((doc_id, sum(len(g[0]) for g in own), sum(len(g[1]) for g in own), len(own), len(linked), best, sum(docs[p] for p in linked), digest))
    return sorted(out, key=str)


def test_alignment_whole(spark, tokenizers, texts):
    got = align.op11_tokenizer_alignment(spark, SMALL)
    assert sorted(map(tuple, got.collect()), key=str) == plain_alignment(tokenizers, texts)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


aligner = align.Aligner(A, B)


@given(st.lists(st.one_of(st.text(st.sampled_from("ab Z,.'\n\t ́é<|>9 　sΣ▁\x00\x1c "), max_size=30), st.text(max_size=20)), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_texts_are_aligned_one_by_one(tokenizers, many):
    many = [t for t in many if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    counts, written, pairs_of, times_of = aligner.align(pa.array(many, pa.string()))
    for text, own, found, pairs, times in zip(many, counts.T.tolist(), written.to_pylist(), pairs_of, times_of, strict=True):
        groups = plain_groups(tokenizers, text)
        assert found == ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        assert own == [sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(len(g[0]) * len(g[1]) for g in groups)]
        want = Counter(x << 32 | y for g in groups for x in g[0] for y in g[1])
        assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == want


def test_alignment_edges(spark, tokenizers, monkeypatch):
    odd = ["a <|endoftext|> b </s> <s>", "x▁y", "  two  spaces ", "tab\tand\n\nlines \n", "éß漢字 😀", "a" * 3000, "word " * 20_000]
    rows = [(1, "the cat sat"), (1, "the cat sat"), (None, "the cat"), (2, None), (3, ""), *enumerate(odd, 4)]
    docs = spark.createDataFrame([(*r, 5, 6, "x") for r in rows], "doc_id long, text string, n_a int, pairs int, TEXT string")
    want = plain_alignment(tokenizers, rows)
    for broadcast in (0, 1000):
        got = align.link_scores(docs, A, B, Scratch(spark, "edges"), broadcast)
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert [r[1:] for r in want if r[0] in (2, 3, 5)] == [(0, 0, 0, 0, 0, 0, "")] * 3
    monkeypatch.setattr(align, "WIDE_SLICE", 1)
    for (_, text), wide in zip(rows, aligner.align(pa.array([t for _, t in rows]))[3], strict=True):
        assert wide.sum() == sum(len(g[0]) * len(g[1]) for g in plain_groups(tokenizers, text))
    kept = align.align(docs, A, B)
    assert {"n_a__in2", "pairs__in2", "TEXT__in2", "groups"} <= set(kept.columns) and kept.count() == len(rows)
    assert align.link_scores(docs.limit(0), A, B, Scratch(spark, "edges")).count() == 0


# 12


def plain_lines(rows):
    own = [(d, (t or "").split("\n")) for d, t in rows]
    small = str.maketrans(lines.UPPER, lines.LOWER)

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(small)

    holders = defaultdict(set)
    for d, ls in own:
        for line in ls:
            if len(key(line)) >= 20 and d is not None:
                holders[key(line)].add(d)
    out = []
    for d, ls in own:
        kept = [x for x in ls if len(key(x)) < 20 or len(holders[key(x)]) < 3 or d == max(holders[key(x)])]
        out.append((d, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines_whole(spark, texts):
    want = [(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in plain_lines(texts)]
    assert sorted(map(tuple, lines.op12_line_dedup(spark, SMALL).collect()), key=str) == sorted(want, key=str)
    assert sum(gone for _, _, gone, _ in want) > 0


def test_lines_edges(spark):
    line, other = "This line is in MANY documents.", "é" * 19
    rows = [(1, f" {line}\t\nown one"), (2, f"{line.lower()}\r\n{line}\n"), (3, f"a\n{line}\nb"), (3, f"{line}\nanother text"), (3, f"a\n{line}\nb"), (None, line), (None, "null"), (4, None), (5, ""), (6, "\n\n")]
    rows += [(i, f"{other}\n{other}x") for i in range(10, 13)] + [(20, line + "\n" + "w " * 200_000), (21, (line + "\n") * 5000)] + [(30 + i, "only two documents have it") for i in range(2)]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n_lines int, KEPT string")
    got = lines.drop_common_lines(docs, Scratch(spark, "edges"))
    assert {"n_lines__in2", "KEPT__in2"} <= set(got.columns)
    assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=str) == plain_lines(rows)
    assert lines.drop_common_lines(docs.limit(0), Scratch(spark, "edges")).count() == 0


def test_a_line_in_most_documents_is_spread(spark):
    """No task of the counts holds the line's documents: partial sums go by key and document first."""
    docs = spark.range(4000).repartition(4).selectExpr("id doc_id", "concat('a line that all documents have\n', 'own text number ', id, ' of many') text")
    got = lines.drop_common_lines(docs, Scratch(spark, "edges"))
    assert got.filter("n_dropped = 1").count() == 3999 and got.filter("n_dropped = 0").collect()[0]["doc_id"] == 3999
    plan = lines.common_lines(lines.keyed_lines(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "doc_id" in plan.split("Exchange hashpartitioning(")[-1].split(")")[0]


# 13


def plain_repair(rows):
    """All ways, whole strings: (cost, edits, repaired lines) of rows (role, text, fault)."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    ways = {"": (0, "", [])}  # by the last initial kept, which is the state of (s?(ua)+)?
    for role, text, fault in rows:
        later = {}
        for state, (cost, edits, out) in ways.items():
            found = [(state, cost + 3, edits + "D", out)]
            if fault not in ("blank", "duplicate"):
                more, at, own, c, e = fault == "truncated", state, out, cost, edits
                for _ in range(4):
                    if role[:1] == step[at] or (role[:1] == "s" and at == ""):
                        found.append((role[:1], c + more, e + "K", [*own, f"{role}:{text}"]))
                    name = {"u": "user", "a": "assistant"}[step[at]]
                    found.append((step[at], c + 2 + more, e + "R", [*own, f"{name}:{text}"]))
                    at, own, c, e = step[at], [*own, f"{name}:"], c + 2, e + "I"
            for key, *way in found:
                if key not in later or tuple(way[:2]) < later[key][:2]:
                    later[key] = tuple(way)
        ways = later
    ends = {"": [], "a": [], "u": ["assistant:"], "s": ["user:", "assistant:"]}
    return min(((c + 2 * len(ends[s]), e + "I" * len(ends[s]), [*out, *ends[s]]) for s, (c, e, out) in ways.items()), key=lambda w: w[:2])


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_conversations(rows):
    """Digest rows of op13 from (conv_id, turn, role, text)."""
    out = []
    for conv_id in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in (r for r in rows if r[0] == conv_id):
            role, text = role if role is not None else " ", text if text is not None else " "
            name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
            kind = zlib.crc32(name.encode()) % 20
            text = {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(kind, text)
            own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        fault = plain_faults([r[1:] for r in own])
        cost, audit, kept = plain_repair([(r[1], r[2], f) for r, f in zip(own, fault, strict=True)])
        turns_in = {r[0] for r in own} - {None}
        gaps = max(turns_in) - min(turns_in) + 1 - len(turns_in) if turns_in else 0
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(own))
        counts = Counter(fault)
        out.append((conv_id, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def repaired(spark, tmp_path, rows, columns="conv_id long, turn long, role string, text string"):
    spark.createDataFrame(rows, columns).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return sorted(map(tuple, turns.op13_conversation_repair(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_conversations_whole(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = turns.op13_conversation_repair(spark, f"/root/testdata/{sf}")
    assert sorted(map(tuple, got.collect()), key=str) == plain_conversations(rows)


def run_of(rows):
    """Edits and cost of rows (initial, fault) by the forgetting search."""
    ways, edits = turns.Survivors(), []
    for initial, fault in rows:
        edits += ways.step(initial, fault)
    cost, rest, ending = ways.end()
    return cost, "".join(edits + rest) + ending


@given(st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from(["", "", "", "truncated", "blank", "duplicate"])), max_size=14))
@settings(max_examples=1500, deadline=None)
def test_the_search_finds_the_least_string_of_the_cheapest(rows):
    want = plain_repair([(i, "", f) for i, f in rows])
    assert run_of([("" if i == "x" else i, f) for i, f in rows]) == want[:2]


def unresolved(ways):
    nodes = set()
    for _, _, node in ways.best.values():
        while node is not ways.root:
            nodes.add(id(node))
            node = node.before
    return len(nodes)


def test_settled_rows_are_forgotten():
    """Regular stretches settle at once; of rows that all are users two ways stay, in time that grows with the rows."""
    ways, most = turns.Survivors(), 0
    for k in range(20_000):
        ways.step("ua"[k % 2] if k % 97 else "u", "blank" if k % 31 == 0 else "truncated" if k % 7 == 0 else "")
        most = max(most, unresolved(ways)) if k % 50 == 0 else most
    assert most < 100
    ways = turns.Survivors()
    for _ in range(5000):
        ways.step("", "blank")
    assert unresolved(ways) == 0
    rows = [("u", "")] * 30_001
    assert run_of(rows)[0] == 30_000 + 2


def test_conversations_edges(spark, tmp_path):
    rows = [(1, None, "user", "Hi."), (1, None, "user", "Hi."), (1, 3, None, None), (1, 3, "assistant", "Yes."), (1, 3, "assistant", "No."), (None, 0, "user", "x."), (None, 9, "assistant", " \t\n"), (2, None, None, None)]
    rows += [(3, t, "user", "The same.") for t in range(40)] + [(4, -5, "system", "S."), (4, 7, "Assistant", "a "), (4, 8, "", "é…")]
    rows += [(5 + t, t, "assistant", "w " * 50_000 + "!") for t in range(20)] + [(40, t, "ua"[t % 2], f"turn {t}" + "." * (t % 3)) for t in range(300)]
    want = plain_conversations(rows)
    assert repaired(spark, tmp_path, rows) == want
    assert repaired(spark, tmp_path, [(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, fault int") == want
    assert repaired(spark, tmp_path, []) == []
    clash = turns.repair(spark.createDataFrame([(1, 0, "user", "Hi.", "x")], "conv_id int, turn int, role string, text string, ROLE string"))
    assert [r["edit"] for r in clash.collect()] == ["K", "I", None]
