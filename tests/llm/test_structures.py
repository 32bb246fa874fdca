"""Alignment, conversation trie, packing and list ranking against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tests.llm.odd import TEXTS, documents, empty
from tokenizers import Tokenizer

from voltloom.llm import alignment, packing, ranking, registry, tokens, trie

SF = "/root/testdata/sf0.001"
A, B = registry.VOCABULARY, registry.PIECES


# list ranking ---------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("base", [80, 1000])
def test_list_ranked(spark, base):
    rng = random.Random(base)
    names = rng.sample(range(10_000), 300)
    weights = [(rng.randint(0, 5), rng.randint(0, 9)) for _ in names]
    rows = [(n, f, *w) for n, f, w in zip(names, [*names[1:], None], weights)]
    rng.shuffle(rows)
    found = ranking.list_ranked(spark.createDataFrame(rows, "name long, following long, u long, v long"), ["u", "v"], base)
    got = {r["name"]: (r["u"], r["v"]) for r in found.collect()}
    before, want = (0, 0), {}
    for n, w in zip(names, weights):
        want[n] = before
        before = (before[0] + w[0], before[1] + w[1])
    assert got == want


# conversation trie ----------------------------------------------------------------------------------------------

TALK = "conv_id long, turn long, role string, text string, depth string, k1 string, part string, name string, child string"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.sha256(
                f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + mine[h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * words
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], hashlib.sha256(
        ",".join(map(str, sorted(c for c in m if whole[c] == p))).encode()).hexdigest()) for p, m in members.items())


def trie_of(df, **more):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in trie.prefix_trie(df, **more).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def talk(seed=5, n=90):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), 2**60 + 1, 2**60 + 20, 10**6 + 3]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t * 7, rng.choice(["user", "user", None]), rng.choice(["a b", "c", "c", None, "é ü z x"])))
    rows += [(200, None, "user", "first"), (200, 0, "user", "second"), (200, 0, "user", "second"), (200, 0, "user", "also"),
             (None, 0, "user", "nobody's"), (None, 1, "user", "nobody's"), (41, 0, "", ""), (-7, 0, "user", "c"), (-20, 3, "user", "a b")]
    rows += [(300, i, "user", f"w{i % 3}") for i in range(400)]  # one long conversation
    rows += [(c, 0, "user", "same start") for c in range(400, 520)]  # many equal ones
    return rows


@pytest.mark.parametrize("more", [{}, {"block": 40, "base": 60}])
def test_trie_equals_brute_force(spark, more):
    rows = talk()
    df = spark.createDataFrame([(*r, *"xyzuv") for r in rows], TALK).repartition(5)
    assert trie_of(df, **more) == brute_trie(rows)


def test_trie_of_given_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert trie_of(df) == brute_trie([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()])


def test_trie_of_nothing(spark):
    assert trie_of(spark.createDataFrame([], TALK)) == []
    assert trie_of(spark.createDataFrame([(None, 1, "user", "x", *"xyzuv")], TALK)) == []


# alignment ------------------------------------------------------------------------------------------------------

def cut(text):
    """Ids and ends of both tokenizers, by their libraries on the whole text; None if they don't spell it."""
    a_of = Tokenizer.from_file(A)
    a_of.encode_special_tokens = True
    letters = {v: k for k, v in __import__("voltloom.llm.bpe", fromlist=["x"]).byte_letters().items()}
    byte_of = {v: k for k, v in letters.items()}
    b_of = sentencepiece.SentencePieceProcessor(model_file=B)

    def both(t):
        raw = b" " + t.encode()
        a = a_of.encode(" " + t, add_special_tokens=False).ids
        b = b_of.encode(t)
        sa = [bytes(byte_of[x] for x in a_of.id_to_token(i)) for i in a]
        sb = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
              for p in b_of.encode(t, out_type=str)]
        return (a, np.cumsum(list(map(len, sa))), b, np.cumsum(list(map(len, sb)))) if b"".join(sa) == b"".join(sb) == raw else None
    return both if text is None else both(text)


def brute_alignment(texts):
    both, cuts = cut(None), {}
    for t in set(texts):
        cuts[t] = both(t) if t else None
    counts, per = Counter(), {}
    for t, found in cuts.items():
        if found:
            a, ea, b, eb = found
            at_b = {int(e): j for j, e in enumerate(eb)}
            per[t] = [(i, at_b[int(e)]) for i, e in enumerate(ea) if int(e) in at_b]
    for t in texts:
        for i, j in per.get(t, ()):
            counts[cuts[t][0][i], cuts[t][2][j]] += 1
    best = Counter()
    for (a, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for t in texts:
        if not cuts[t]:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, _, b, _ = cuts[t]
        groups, i0, j0 = [], 0, 0
        for i, j in per[t]:
            groups.append(",".join(map(str, a[i0:i + 1])) + "|" + ",".join(map(str, b[j0:j + 1])))
            i0, j0 = i + 1, j + 1
        n = [counts[a[i], b[j]] for i, j in per[t]]
        out.append((len(a), len(b), len(groups), len(n), sum(x == best[b[j]] for x, (_, j) in zip(n, per[t])), sum(n), ";".join(groups)))
    return out


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
ODD = ["a▁b", "▁", " ", "  two  spaces ", "tab\t\tx\r\n\n\ny", "<|endoftext|> <s></s> <0x41> <unk>", "中文字 🙂🙂 ½", "\x00\x01",
       "it's we'll THE'S", "é é ﬁ ①", "the cat sat on the mat", "the cat sat on the mat", "the mat"]


def test_alignment_equals_brute_force(spark):
    given = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts = TEXTS + ODD + given + given[:7]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "old", "old") for i, t in enumerate(texts)],
                                 "doc_id long, text string, n_a string, key string").repartition(3)
    found = alignment.align(docs, A, B, outputs=("groups", "groups_sha256"))
    assert set(found.columns) == {"doc_id", "text", "key", *ALIGNED, "groups_sha256"}
    got = sorted((r["text"] or "", *(r[c] for c in ALIGNED), r["groups_sha256"]) for r in found.collect())
    want = sorted((t or "", *b, hashlib.sha256(b[-1].encode()).hexdigest() if b[-1] else "") for t, b in zip(texts, brute_alignment(texts)))
    assert got == want
    assert alignment.align(empty(spark), A, B).collect() == []
    assert alignment.align(documents(spark), A, B).count() == documents(spark).count()


def test_possible_pairs_are_those_with_a_common_end():
    a, b = [b"", b"ab", b"b", b"cab"], [b"b", b"xb", b"ab", b"", b"b", b"xcab"]
    want = [i * len(b) + j for i, x in enumerate(a) for j, y in enumerate(b) if x and y and (x.endswith(y) or y.endswith(x))]
    assert alignment.possible(a, b).tolist() == want


def test_chunks_leave_ids_as_they_are(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 50)
    bytes_, pieces = tokens.Bytes(open(A, "rb").read()), tokens.Pieces(open(B, "rb").read())
    whole_a, whole_b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    for t in [t for t in TEXTS + ODD if t] + [" ".join(ODD) * 20, "a  b \n c▁ d▁▁ e " * 99, "x" * 999 + " y"]:
        assert "".join(tokens.chunks(t, 50)) == t
        assert bytes_.encode(t, special=True).tolist() == whole_a.encode(t, add_special_tokens=False).ids
        assert pieces.encode(t).tolist() == whole_b.encode(t)


# packing --------------------------------------------------------------------------------------------------------

def pad(n, size):
    return 0 if n & (n - 1) == 0 else size - n


def cost_of(n, size):
    return packing.SHORT if n < size and n & (n - 1) == 0 else size - n


def test_cuts_cost_the_least():
    rng = np.random.default_rng(2)
    for trial in range(60):
        size = 64
        gaps = rng.integers(1, 20, size=rng.integers(1, 40))
        at = np.concatenate([[0], np.cumsum(gaps)])
        penalty = rng.choice([0, 8, 32], size=len(at))
        least = [0] + [None] * (len(at) - 1)
        for j in range(1, len(at)):
            least[j] = penalty[j] + min(least[i] + cost_of(at[j] - at[i], size) for i in range(j) if at[j] - at[i] <= size)
        found = packing.cuts(at, penalty, size)
        widths = np.diff(found)
        assert found[0] == 0 and found[-1] == at[-1] and widths.max() <= size
        cost = sum(cost_of(int(w), size) for w in widths) + sum(penalty[np.searchsorted(at, c)] for c in found[1:])
        assert cost == least[-1]


def test_places_are_near_each_other():
    at, penalty = packing.places(np.array([10, 500]), np.array([700, 1000]), 1000, 32)
    assert at[0] == 0 and at[-1] == 1000 and np.diff(at).max() <= 64 and set(penalty) == {0, 8, 32}
    assert dict(zip(at, penalty))[10] == 8 and dict(zip(at, penalty))[700] == 0


@pytest.mark.parametrize("block", [1 << 14, packing.BLOCK])
def test_packing_keeps_every_id_once(spark, block):
    given = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts = TEXTS + ODD + given
    docs = spark.createDataFrame([(i, t, "old", "old") for i, t in enumerate(texts)],
                                 "doc_id long, text string, start string, ids string").coalesce(3)
    rows = packing.pack(docs, A, outputs=("ids", "ids_crc32"), block=block).collect()
    whole = Tokenizer.from_file(A)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) > 0
    for i, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted(by_doc[i], key=lambda r: r["start"])
        assert [x for r in mine for x in r["ids"]] == ids
        assert [r["start"] for r in mine] == np.cumsum([0, *(r["length"] for r in mine)])[:-1].tolist()
        assert {r["doc_tokens"] for r in mine} == {len(ids)}
    padding = 0
    for mine in by_sequence.values():
        mine.sort(key=lambda r: r["offset"])
        n = sum(r["length"] for r in mine)
        assert [r["offset"] for r in mine] == np.cumsum([0, *(r["length"] for r in mine)])[:-1].tolist() and n <= 1024
        padding += pad(n, 1024)
    assert padding < 0.02 * sum(r["length"] for r in rows)


def test_packing_of_odd_tables(spark):
    assert packing.pack(empty(spark), A).collect() == []
    df = documents(spark)
    rows = packing.pack(df, A, outputs=("ids_crc32",)).collect()
    assert sum(r["start"] == 0 for r in rows) == df.count()
    assert any(r["doc_id"] is None for r in rows)


def test_queries_have_the_columns_asked_for(spark):
    assert registry.QUERIES["op11_tokenizer_alignment"](spark, SF).columns == [
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert registry.QUERIES["op13_packing"](spark, SF).columns == [
        "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"]
    assert public_tokenizers.path("byte_bpe_50k.json") == A
