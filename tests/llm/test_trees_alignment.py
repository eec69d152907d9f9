"""Alignment, prefix trie and chat formatting against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.llm.conftest import ODD_TEXTS
from vocatio.llm import alignment, chats, trie
from vocatio.llm.bpe import byte_letters
from vocatio.llm.common import laid, running

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TURNS = "conv_id long, turn long, role string, text string, conv long, depth string, node int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_alignment(texts):
    library, pieces = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    byte = {c: i for i, c in enumerate(byte_letters())}
    rows, count, best = [], Counter(), Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        shown = [[bytes(byte[c] for c in library.id_to_token(i)) for i in a]]
        shown.append([bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b])
        if text and any(b"".join(s) != whole for s in shown):
            a, b, shown = [], [], [[], []]
        ends = [_ends(s) for s in shown]
        groups, links, last = [], [], (0, 0)
        for end in sorted(ends[0].keys() & ends[1].keys()):
            here = ends[0][end], ends[1][end]
            groups.append("|".join(",".join(map(str, ids[s:e])) for ids, s, e in zip((a, b), last, here)))
            links.append((a[here[0] - 1], b[here[1] - 1]))
            last = here
        count.update(links)
        rows.append((len(a), len(b), groups, links))
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return [
        (na, nb, len(g), len(p), sum(count[x] == best[x[1]] for x in p), sum(count[x] for x in p), sha(";".join(g)) if na else "") for na, nb, g, p in rows
    ]


def _ends(tokens):
    ends, at = {}, 0
    for k, t in enumerate(tokens):
        at += len(t)
        ends[at] = k + 1
    return ends


def test_common_ends():
    rng = random.Random(2)
    for n, m in ((0, 0), (0, 5), (1, 1), (300, 40), (40, 300), (1000, 1000), (3, 5000)):
        a, b = (np.array(sorted(rng.sample(range(6000), k)), np.int64) for k in (n, m))
        ia, ib = alignment.common_ends(a, b)
        assert a[ia].tolist() == b[ib].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


@pytest.mark.parametrize("limits", [{}, {"limit": 0, "heavy": 20}])
def test_alignment(docs_of, odd_pairs, limits):
    rng = random.Random(4)
    letters = "ab 'stre<|endoftext|></s>\n\t.!5é漢½İΣ́\x1f ▁ \x85\0"
    pairs = [*odd_pairs, *((200 + i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for i in range(200))]
    docs = docs_of(pairs).repartition(3)
    want = [(i, *row) for (i, _), row in zip(pairs, plain_alignment([t for _, t in pairs]))]
    assert Counter(map(tuple, alignment.align(docs, A, B, digest=True, **limits).collect())) == Counter(want)


def test_alignment_shows_groups(docs_of):
    docs = docs_of([(1, "Hello world"), (2, None)])
    rows = {r.doc_id: r for r in alignment.align(docs, A, B).collect()}
    a, b = Tokenizer.from_file(A).encode(" Hello world").ids, SentencePieceProcessor(model_file=B).encode("Hello world")
    assert rows[1].groups == ";".join(f"{x}|{y}" for x, y in zip(a, b)) and rows[2].groups == "" and rows[1].n_best == 2
    assert alignment.align(docs.limit(0), A, B).count() == 0


def test_blocks_do_not_change_alignment():
    texts, aligner = [t or "" for t in ODD_TEXTS], alignment.Aligner(A, B)
    one = [(r["groups"], r["pairs"].tolist()) for r in aligner.align(texts)]
    assert one == [(r["groups"], r["pairs"].tolist()) for b in alignment.blocks(texts, 1) for r in aligner.align(b)]


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built, members, children, leaves, saved = {}, defaultdict(list), defaultdict(int), Counter(), Counter()
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, held in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(held) - 1) * len(k[-1][1]) if k else 0
    return Counter(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children.get(k, 0), leaves[k], saved[k], sha(",".join(str(c) for c in m if len(built[c]) == len(k))))
        for k, m in members.items()
    )


def odd_turns(n=140, seed=1):
    """Conversations that share beginnings, one of a third of all rows, copies, ties, nulls, negative ids and missing first ones."""
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["same", "a", "", None, "two\nlines"])) for c in range(n) for t in range(rng.randint(1, 7))]
    rows += [(7000 + i, t, "user", f"copy {t}") for i in range(80) for t in range(3)]
    rows += [(130, 100 + i, "user", "long" * (i % 3)) for i in range(len(rows) // 2)]
    rows += [(-5, 0, None, "x"), (-5, None, "user", "first"), (-105, 3, "user", "x"), (141, 0, "user", "tie"), (141, 0, "user", "tie"), (141, 0, "a", "tie")]
    rows += [(None, 0, "user", "nobody's"), (None, None, None, None)]
    return [(*r, 1, "x", 2) for r in rows]


@pytest.mark.parametrize("alone", [1 << 14, 300])
def test_trie(spark, alone):
    rows = odd_turns()
    turns = spark.createDataFrame(rows, TURNS).repartition(5)
    assert Counter(map(tuple, trie.prefix_trie(turns, alone=alone).collect())) == plain_trie(rows)


def test_trie_without_rows(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", 1, "x", 2)], TURNS)).count() == 0


def test_list_ranks(spark):
    order = list(range(1000))
    random.Random(3).shuffle(order)
    links = spark.createDataFrame(list(zip(order, [*order[1:], trie.END])), "arc long, to long")
    ranks = dict(map(tuple, trie.list_ranks(links, alone=50, every=16).collect()))
    assert ranks == {arc: len(order) - i for i, arc in enumerate(order)}


def test_running_sums_over_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), i, rng.randint(-3, 3)) for i in range(500)]
    placed = laid(spark.createDataFrame(rows, "g int, i int, v int").repartition(7), ["g", "i"])
    got = {r.i: (r.total, r.then) for r in running(placed, ["g"], {"total": placed.v}, {"then": "i"}).collect()}
    want, last, total = {}, {}, Counter()
    for g, i, v in rows:
        total[g] += v
        want[i] = (total[g], None)
        if g in last:
            want[last[g]] = (want[last[g]][0], i)
        last[g] = i
    assert got == want


def plain_chats(rows):
    mark, by_conv = re.compile(r"\[/?INST\]|</?s>"), defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by_conv[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by_conv.items():
        said = [t[2:] for t in sorted(turns)]
        learnt = "".join(t for r, t in said if r == "assistant")
        n = sum(21 + len(r) + len(t) + len(mark.findall(r + " " + t)) for r, t in said)
        out.append((conv, len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(learnt), sha(learnt), n))
    return Counter(out)


MARKS = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>\\[INST] x\\ </s> [/INST] \\", " $1 \\ 🎉<s>", "🎉</s> y", "[INST", "\\\\\\[/INST]\n</s>"]


def test_chats(spark):
    rows = odd_turns(seed=2) + [(-1, i, role, text, 1, "x", 2) for i, text in enumerate(MARKS) for role in ("user", "assistant", "a [/INST] b")]
    turns = spark.createDataFrame(rows, TURNS).repartition(4)
    assert Counter(map(tuple, chats.report(turns).collect())) == plain_chats(rows)
    assert chats.report(turns.limit(0)).count() == 0


def test_marks_in_outputs_are_the_templates_own(spark):
    turns = spark.createDataFrame([(1, i, "assistant", t, 1, "x", 2) for i, t in enumerate(MARKS)], TURNS)
    row = chats.format_threads(turns).first()
    assert len(re.findall(r"(?<!\\)</s>", row.formatted)) == len(MARKS) == len(row.loss)
    back = chats.read_back(chats.format_threads(turns)).first()
    assert back.learnt == MARKS == [t.text for t in back.turns]


def test_reply_trees(spark):
    rows = [
        ("a", 1, None, "user", "q", 0.0), ("a", 2, 1, "assistant", "r1", 1.0), ("a", 3, 1, "assistant", "r2", 5.0), ("a", 4, 3, "user", "s", None),
        ("a", 5, 4, "assistant", "t", 1.0), ("b", 1, 9, "user", "lone", float("nan")), ("b", 7, 1, None, None, 0.0), ("b", 7, 1, None, None, 0.0),
    ]
    replies = spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double")
    found = {w: Counter((r.tree, r.rank, r.formatted) for r in chats.format_replies(replies, whole=w).collect()) for w in (10_000, 1)}
    assert found[1] == found[10_000] and sum(found[1].values()) == 4
    best = {r.tree: r for r in chats.format_replies(replies, best=1).collect()}
    assert best["a"].formatted == "".join(f"[INST] {r} [/INST] {t} </s>" for r, t in (("user", "q"), ("assistant", "r2"), ("user", "s"), ("assistant", "t")))
    assert [best["a"].formatted[s.start : s.start + s.length] for s in best["a"].loss] == ["r2", "t"] and best["b"].rank == 1
    with pytest.raises(ValueError):
        chats.format_replies(spark.createDataFrame([("a", 1, 2, "u", "x", 0.0), ("a", 2, 1, "u", "y", 0.0)], replies.schema)).count()
