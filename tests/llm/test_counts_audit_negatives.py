"""Token counts, filter audit and hard negatives against the library and against brute force."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import filter_audit, negatives, token_counts

MODEL = P.path("piece_bpe_32k.model")
RNG = np.random.default_rng(11)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


SIGNS = " ▁\n\t\x00abcdeinrst.,!#-=_019éß中文字😀́　​ﬁ"


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(SIGNS, max_size=80), st.lists(st.sampled_from(["the", " ", "  ", "▁", "tion", "\n", "<s>", "</s>", "<unk>", "<0x0A>", "12", "====", "é"]), max_size=30).map("".join)))
def test_pieces_of_pre_tokens_are_the_pieces_of_the_text(text):
    split = token_counts.pre_tokens(MODEL)
    parts = split(text)
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert sum(split.count(parts)) == len(own.encode(text))
    assert "".join(parts) == (" " + text.replace("▁", " ") if text else "")


def test_counts_with_frequent_and_other_pre_tokens(spark, library, monkeypatch):
    monkeypatch.setattr(token_counts, "STEP", 7)
    long = " ".join(RNG.choice(["the", "house", "=" * 90, "中文字中文", "x1"], 3_000))
    texts = [None, "", " ", "  a  b ", "▁a", long, long[::-1], "=" * 90, "q" * 5_000, "a\nb " * 40, "\x00"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(5, long, "x", 1), (None, long, "x", 1), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pieces string, row int").repartition(3)
    key = lambda i: -1 if i is None else i
    want = sorted((key(i), len((t or "").encode()), len(library.encode(t or ""))) for i, t, *_ in rows)
    for frequent in (0, 5, 1 << 17):
        got = token_counts.token_counts(docs, MODEL, frequent).collect()
        assert sorted((key(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want, frequent
    assert token_counts.token_counts(docs.where("false"), MODEL).count() == 0


def test_each_distinct_pre_token_is_counted_once(spark):
    docs = spark.createDataFrame([(i, "the house, the 12 houses" * (i % 3)) for i in range(40)], "doc_id long, text string").repartition(5)
    rows = token_counts.distinct_pre_tokens(docs, MODEL).collect()
    split, want = token_counts.pre_tokens(MODEL), Counter()
    for i in range(40):
        want.update(split("the house, the 12 houses" * (i % 3)))
    assert {r.pre_token: r.n for r in rows} == want and len(rows) == len(want)
    few = token_counts._frequent(token_counts.distinct_pre_tokens(docs, MODEL), 3)
    assert 0 < len(few) <= 3 and set(few) <= {p for p, _ in want.most_common(3)}


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    for change in ("unigram", "spaces", "symbols"):
        model = pb.ModelProto.FromString(open(MODEL, "rb").read())
        if change == "unigram":
            model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
        elif change == "spaces":
            model.normalizer_spec.remove_extra_whitespaces = True
        else:
            model.pieces[400].type = model.SentencePiece.USER_DEFINED
        (tmp_path / change).write_bytes(model.SerializeToString())
        with pytest.raises(ValueError):
            token_counts.PreTokens(str(tmp_path / change))


def plain_audit(docs, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and x(q, t)} for x in (lambda q, t: q == 1, lambda q, t: t == 1))
    rows = []
    for i, t, source in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        rows.append((source or "", {c for c, f in fails.items() if f}, i in good, i in toxic))
    out, total = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, c in enumerate(order, 1):
                gone = [r for r in own if r[0] & set(order[: step - 1])]
                here = [r for r in own if c in r[0] and not r[0] & set(order[: step - 1])]
                total[part, c] += len(here)
                out[part, order, step] = [
                    len(own) - len(gone) - len(here), len(here), sum(c in r[0] for r in gone), sum(r[0] == {c} for r in own), sum(r[1] for r in here), sum(r[2] for r in here),
                ]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_equals_brute_force(spark):
    words = [f"w{i}" for i in range(400)]
    many = " ".join(words)
    texts = [None, "", "\n", many, many, many, many + " #", "Aa " + many, "a " * 300, "AB " * 150, many.upper(), "x " * 5_000 + "$", "İ Ö", " " + many + "\x0b\x0c\r"]
    docs = [(i, t, ("s", None, "", "t")[i % 4]) for i, t in enumerate(texts)]
    docs += [(2, many, "s"), (2, many, "s"), (None, many, "t"), (None, None, None), (4, many, "u"), (99, "AB " * 150, "s")]
    docs += [(int(i), str(RNG.choice(texts[1:])), str(RNG.choice(["s", "t"]))) for i in range(100, 130)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(60)] + [(3, 0, 0), (4, 1, 1), (4, 1, 1), (None, 1, 1), (5, None, None), (120, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    d = spark.createDataFrame([(*r, 7, "c") for r in docs], "doc_id long, text string, source string, mask int, part string").repartition(3)
    g = spark.createDataFrame([(*r, "c") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit(filter_audit.cells(d, g)).collect()
    assert len(got) == len({(r.part, r.filter_order, r.step) for r in got})
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == plain_audit(docs, labels)
    assert filter_audit.audit(filter_audit.cells(d.where("false"), g)).count() == 0
    none = filter_audit.audit(filter_audit.cells(d, g.where("false"))).agg({"good_lost": "sum", "kept": "sum"}).first()
    assert none["sum(good_lost)"] == 0 and none["sum(kept)"] > 0


def test_audit_of_more_parts_than_the_recursion_row_limit(spark):
    cells = spark.range(4_000).selectExpr("concat('p', id) part", "cast(id % 8 as int) mask", "1L n", "0L good", "0L toxic")
    got = filter_audit.audit(cells, 3)
    assert got.count() == 4_000 * 6 * 3
    row = got.where("part = 'p7' AND filter_order = 'CAB' AND step = 2").first()
    assert (row.kept, row.removed, row.redundant, row.unique_fails, row.shapley) == (0, 0, 1, 0, 2)


def plain_negatives(rows, anchors, k=5):
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in anchors:
        label, v = rows[a]
        ranked = sorted((-score(v, w), i, other) for i, (other, w) in rows.items() if i != a)
        for s, i, _ in [x for x in ranked if x[2] == label][:k]:
            fit = [(n, j) for n, j, other in ranked if other != label and 80 * -s <= 100 * -n <= 100 * -s][:k]
            out += [(a, i, r, j, -s, -n) for r, (n, j) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(4096, 2048), (7, 3)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(negatives, "ROW_BLOCK", blocks[0])
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", blocks[1])
    vectors = RNG.integers(-3, 4, (150, 5)) / 256.0
    vectors[40:60] = vectors[0]
    data = [(i, v.tolist(), int(RNG.integers(0, 3)) if i % 10 else 2) for i, v in enumerate(vectors)]
    bad = [(200, None, 1), (201, [0.1, None], 1), (202, [float("inf")], 1), (203, [0.2], None), (None, [0.3], 1), (210, [], 0), (220, [0.0] * 5, 1), (230, [0.01, 0.02, 0.0, 0.0, 0.0, 0.01], 2)]
    df = spark.createDataFrame([(*r, 1, "c") for r in [*data, *bad, data[3], data[0]]], "vec_id long, embedding array<float>, label int, score int, windows string")
    rows = negatives.labelled_vectors(df)
    have = {i: (label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in [*data, bad[5], bad[6], bad[7]]}
    assert {r.vec_id: (r.label, list(r.v)) for r in rows.collect()} == have
    got = sorted(tuple(r) for r in negatives.hard_negatives(rows.where("vec_id % 10 = 0"), rows).collect())
    want = plain_negatives(have, [i for i in have if i % 10 == 0])
    assert got == want and len({r[0] for r in want}) > 5
    assert negatives.hard_negatives(rows.where("false"), rows).count() == 0
    assert negatives.hard_negatives(rows.where("false"), rows.where("false")).count() == 0


def test_an_id_on_several_rows_counts_once(spark):
    df = spark.createDataFrame([(1, [0.5], 4), (1, [0.25], 4), (1, [0.1], 9), (2, [0.5], 4)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id, r.label, list(r.v)) for r in negatives.labelled_vectors(df).collect()) == [(1, 4, [64]), (2, 4, [128])]


def test_reading_stops_below_every_kth_score():
    """On lists with a clear head the threshold ends the search early; what it leaves unseen is below the k-th score."""
    rows = RNG.integers(-9, 10, (4000, 6))
    rows[RNG.choice(4000, 40, replace=False)] *= 40
    lists = negatives.Lists(rows)
    early = 0
    for _ in range(20):
        anchor = RNG.integers(-5, 6, 6)
        allowed = RNG.random(4000) < 0.7
        top = int((rows @ anchor).max())
        windows = [(-(-80 * top // 100), top), (negatives.LEAST, top - 1), (top + 1, negatives.MOST)]
        found = lists.search(anchor, allowed, windows, 5)
        early += int((lists.scores != rows @ anchor).any())
        for (least, most), places in zip(windows, found):
            score = rows @ anchor
            fit = np.flatnonzero(allowed & (score >= least) & (score <= most))
            best = fit[np.argsort(-score[fit], kind="stable")[:5]]
            assert places[np.argsort(-score[places], kind="stable")[:5]].tolist() == best.tolist()
    assert early > 0
