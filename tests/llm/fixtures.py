"""Small documents with every awkward case, and the rules of the contracts in plain Python."""

import re

LONG = "lorem ipsum dolor sit amet consectetur " * 4000
BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix boxes of dark liquor jugs"

ROWS = [
    (0, BASE, "en", "a"), (1, BASE + " today", "en", "a"), (2, BASE, "en", None), (3, None, "en", "b"), (4, "", None, "b"), (5, "   \t \n ", "en", "b"),
    (6, LONG, "en", "c"), (7, "Ünïcode wörds ÀÉ   with  spaces\tand\ttabs\r\nand lines", "de", "c"), (7, "Ünïcode wörds ÀÉ   with  spaces\tand\ttabs\r\nand lines", "de", "c"),
    (8, "one\ntwo\nthree four five six seven\nONE\nthree four five six seven eight", "en", "a"), (9, "three four five six seven\n" + BASE, "fr", "a"), (None, "no number here but words", "en", "a"),
    (10, "same", "en", "a"), (11, "same", "en", "b"), (12, "<|endoftext|> is ordinary # here", "en", "c"), (13, "word " * 500, "en", "d"),
]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", lower(text))


def documents(spark, rows=ROWS, clash=True):
    """With extra columns whose names the operators use themselves."""
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if clash:
        frame = frame.selectExpr("*", "'x' as score", "1 as shard", "2.5 as size", "'k' as key", "7 as n_tokens", "'w' as w", "0 as fp", "'r' as row", "'b' as block", "1 as copies")
    return frame


def empty(spark):
    return documents(spark).where("false")
