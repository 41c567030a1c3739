"""Runs longer than LETTERS bytes: every byte is read, in training windows and in scoring."""

import numpy as np

from kvframe.llm import toxicity


def test_middle_of_unspaced_text_counts():
    rest = "这是一个没有空格的很长的句子" * 300
    texts = [t.encode() for t in (rest + rest, rest + "混蛋白痴去死" + rest)]
    model = toxicity.Model(toxicity.initial(0), np.zeros(0, np.uint64))
    words = toxicity.Words(texts)
    windows, owner = words.windows()
    scores = model.windows(model.tables(words), windows)
    assert set(scores[owner == 0].tolist()) != set(scores[owner == 1].tolist())
    assert any("混蛋白痴".encode() in w for w in toxicity.words_of(texts[1]))


def test_pieces_cover_every_byte():
    for n in (1, 31, 32, 33, 47, 48, 49, 60, 61, 64, 65, 500):
        for raw in (b"x" * n, ("é" * n).encode(), ("字" * n).encode(), b"\xbf" * n):
            buf = np.frombuffer(b" " + raw + b" ", np.uint8)
            start, end = toxicity.pieces(buf, np.array([1]), np.array([1 + len(raw)]))
            assert start[0] == 1 and end[-1] == 1 + len(raw) and (end - start).max() <= toxicity.LETTERS
            assert (start[1:] <= end[:-1]).all() and (start[1:] > start[:-1]).all()
            assert len(toxicity.words_of(buf.tobytes())) == len(start) == toxicity.Words([buf.tobytes()]).bounds[1]
