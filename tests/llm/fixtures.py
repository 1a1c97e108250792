"""Rows that cover the edge cases: nulls in every column, empty and long texts, ties,
repeated rows, an empty table, and extra columns whose names the operators use inside."""

PROSE = ("The miller walked down to the river before dawn and counted the boats that had come in overnight, "
         "seven of them, each with a lamp still burning at the bow and nobody awake on deck to answer his call.\n"
         "By noon the market had filled the square with noise, cheese, wet wool and arguments about the price of salt, "
         "and the old bell above the hall struck twelve as if it doubted the hour.")
LONG = " ".join(f"word{i * 7919 % 10007}" for i in range(40_000))

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, copy int, row string, digest string, "
          "node string, text_key string, shuffle_key string, doc string, keys string, `a.b` string, class long")

TEXTS = [(1, PROSE), (2, PROSE), (2, PROSE), (None, PROSE), (3, None), (4, ""), (5, "  \n\t "), (6, None), (None, None),
         (7, LONG), (8, "one"), (9, "one  two\nthree"), (10, "one two three"), (11, "é ñ 日本語 😀 \x85 \xa0 x"),
         (12, PROSE.replace("miller", "baker")), (13, "</s><|end|>\\ [INST] it's 'S <|endoftext|> \x00 z"),
         (14, "a@b.example.com 1.2.3.4 and 4111 1111 1111 1111 or +49 (170) 555-1234 idiot")]


def edge_docs(spark):
    rows = [(i, t, None if k % 3 else "en", None if k % 2 else "s1", None, 9, "r", None, "n", "tk", None, "d", None, "dot", None)
            for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
