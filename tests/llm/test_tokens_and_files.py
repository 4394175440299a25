import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm import common, packing, token_files
from tidemark.llm.tokens import Encoder

from . import fixtures as fx

ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \n b  c d", "x" * 100 + " y", "​ a  　 b", "<|endoftext|> a <|endoftext|>", "it's  don't 12 3a", "\x1c a\x1c b", "日本語 テキスト　です ね", "foo' bar's !!'s", "a.\nB", "x é,\nÑo.\n\nz", "w it's.\nx", "### a### b"]


def test_encoder_is_the_library():
    e = Encoder(fx.vocabulary())
    for _ in range(2):  # the second time from the cache
        for text, ids in zip(ODD, e.ids(ODD)):
            assert list(np.frombuffer(ids, "<u4")) == e.tokenizer.encode(text, add_special_tokens=False).ids, text


def in_each_order(texts):
    import itertools

    e = Encoder.of(fx.vocabulary())
    want = {text: e.tokenizer.encode(text, add_special_tokens=False).ids for text in texts}
    for order in itertools.permutations(texts):
        e.forget()
        for text in order:
            assert list(np.frombuffer(e.ids([text])[0], "<u4")) == want[text], (order, text)
        e.forget()
        for text, ids in zip(order, e.ids(list(order))):
            assert list(np.frombuffer(ids, "<u4")) == want[text], (order, text)


def test_a_line_that_starts_after_a_blank_keeps_it_whatever_was_cached_before():
    in_each_order(["The a", "x \nThe b", "y\nThe c"])


def test_marks_after_anything_but_letters_are_not_cut_off():
    in_each_order(["a ", "b --", "b -- c"])
    for core in ["say…", "a—", "x®", "é”", "…", "12"]:
        in_each_order([f"a {core} b", *(f"c {core}{mark} d" for mark in '".,)'[:3]), f"{core}) e"])


def test_a_shared_cache_never_changes_what_the_library_gives():
    import random

    from tokenizers import Tokenizer

    r, e, library = random.Random(1), Encoder(fx.vocabulary()), Tokenizer.from_file(fx.vocabulary())
    kinds = ["foo", "bar", "The", "a", "é", "say…", "x®", "12", "日本", "don't", "it's", "'", "'s", "...", "--", "!", ")", "_", "<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "\xa0", "\u200b", "\x1c", "\u3000", "ſ", "ª", "İ", "😀", "ƀ", "\x85", "\r\n", "#"]
    texts = ["".join(r.choice(kinds) for _ in range(r.randint(0, 9))) for _ in range(20_000)]
    for text, ids in zip(texts, e.ids(texts)):
        assert list(np.frombuffer(ids, "<u4")) == library.encode(text, add_special_tokens=False).ids, text


def test_a_part_before_a_blank_is_cut_there_only_where_the_text_may_be():
    in_each_order(["a b\n", "a b\n c", "a b c"])
    in_each_order(["a ", "a  b", "a b"])
    in_each_order(["a\t b", "\t b", "b a\u2060 b", "b a\u2060"])


def test_plain_words_and_their_marks_need_no_regular_expression(monkeypatch):
    from tidemark.llm import tokens

    class Counted:
        asked = 0

        def fullmatch(self, part, kept=tokens._SIMPLE):
            self.asked += 1
            return kept.fullmatch(part)

    e, simple = Encoder(fx.vocabulary()), Counted()
    monkeypatch.setattr(tokens, "_SIMPLE", simple)
    text = " plain words, of one line. Some again!! words, plain"
    assert list(np.frombuffer(e.ids([text])[0], "<u4")) == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert simple.asked == 0
    text = " it's (marked) ñandú's"
    assert list(np.frombuffer(e.ids([text])[0], "<u4")) == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert simple.asked == 3


def expected(rows, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(fx.vocabulary())
    return [(i, np.array(t.encode(x or "", add_special_tokens=False).ids + [end], "<u4")) for i, x, *_ in rows]


def test_op9_against_the_library(spark, tmp_path):
    rows = fx.odd_rows()
    got = token_files.query(spark, fx.saved(fx.odd(spark), tmp_path)).collect()
    want, at = [], 0
    for i, ids in sorted(expected(rows, 2), key=lambda x: (x[0] is not None, x[0] or 0)):
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    assert sorted(((g.doc_id, g.n_tokens, g.ids_crc32) for g in got), key=key) == sorted(want, key=key)
    for g in sorted(got, key=lambda g: g.start):
        assert g.start == at
        at += g.n_tokens
    ids = [g.doc_id for g in sorted(got, key=lambda g: g.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_hold_lists_in_the_encoding_with_page_indexes(spark, tmp_path, encoding):
    docs = fx.table(spark, fx.near_rows())
    path = f"{tmp_path}/ids"
    token_files.write_tokens(docs, fx.vocabulary(), path, encoding=encoding)
    files = sorted(tmp_path.glob("ids/*.parquet"))
    column = next(c for f in files for g in [pq.ParquetFile(f).metadata.row_group(0)] for c in map(g.column, range(g.num_columns)) if c.path_in_schema.startswith("ids"))
    assert column.has_offset_index
    assert ("DELTA_BINARY_PACKED" if encoding == "delta" else "RLE_DICTIONARY") in " ".join(column.encodings) or "PLAIN_DICTIONARY" in column.encodings
    slim = token_files.read_tokens(spark, path, ())
    assert slim.columns == ["doc_id", "start", "n_tokens"] and slim.count() == docs.count()
    plan = slim._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_op1_places_every_piece_once_and_without_gaps(spark, tmp_path):
    rows = fx.odd_rows()
    got = packing.query(spark, fx.saved(fx.odd(spark), tmp_path)).collect()
    want = []
    for i, ids in expected(rows, 0):
        first = (len(ids) - 1) % 2048 + 1
        edges = [0, *range(first, len(ids) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted(map(repr, want)) == sorted(repr((g.doc_id, g.piece, g.start, g.length, g.ids_crc32)) for g in got)
    filled = {}
    for g in sorted(got, key=lambda g: (g.sequence_id, g.offset)):
        assert g.offset == filled.get(g.sequence_id, 0)
        filled[g.sequence_id] = g.offset + g.length
    assert max(filled.values()) <= 2048


def test_plan_uses_every_length_and_few_sequences():
    import random

    for seed in range(150):
        r = random.Random(seed)
        capacity = r.choice([10, 64, 2048])
        counts = {r.randint(1, capacity): r.randint(1, 50) for _ in range(r.choice([0, 1, 5, 200]))}
        kinds = packing.plan(dict(counts), capacity)
        used = {}
        for content, many in kinds:
            assert many > 0 and sum(n * k for n, k in content) <= capacity
            assert sum(k for n, k in content if 3 * n > capacity) <= 2
            for n, k in content:
                used[n] = used.get(n, 0) + k * many
        assert used == counts
        gaps = []
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                fit = [i for i, g in enumerate(gaps) if g >= n]
                if fit:
                    gaps[min(fit, key=gaps.__getitem__)] -= n
                else:
                    gaps.append(capacity - n)
        assert sum(m for _, m in kinds) <= 1.02 * len(gaps) + 1


def test_empty_tables(spark, tmp_path):
    at = fx.saved(fx.empty(spark), tmp_path)
    assert packing.query(spark, at).count() == 0
    assert token_files.query(spark, at).count() == 0


def test_free_names(spark):
    assert common.free(fx.empty(spark), "Row") == "_Row"
