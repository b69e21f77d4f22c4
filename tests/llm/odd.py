"""Rows that operators must stand: nulls in any column, empty and long texts, repeated rows, clashing names."""

CLASHING = "fp row ids n_tokens score k1 k2 component_id part words id text_hash own mask stretch list rule label hash kept_text __keep_id __keep_hash __keep_hash_of __k1 __k2 __kept"

TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank"),
    (2, "the quick brown fox jumps over the lazy dog near the river bank"),
    (2, "the quick brown fox jumps over the lazy dog near the river bank"),
    (3, None),
    (4, ""),
    (None, "an orphan row without an id"),
    (None, None),
    (5, " \n\t "),
    (6, "word " * 4000),
    (7, "x" * 9000),
    (8, "İstanbul'da ÇOK güzel 日本語 テキスト 😀 don't I'll <|endoftext|> <|ENDOFTEXT|> á ²½"),
    (9, "Released under the MIT License.\nfoo bar, baz."),
    (10, "ab" * 300),
]


def odd_docs(spark):
    rows = [(i, t, None, None, None if t is None else len(t), *[None] * len(CLASHING.split())) for i, t in TEXTS]
    clashing = ", ".join(f"{name} string" for name in CLASHING.split())
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {clashing}")
