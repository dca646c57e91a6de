import pytest


def _thue_morse(n):
    """A word of n letters a and b and its complement: sums of powers of an odd base modulo 2^64 cannot tell them apart."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return [word, word.translate(str.maketrans("ab", "ba"))]


ODD_TEXTS = [
    None, "", " ", "   ", "a", " a", "a ", "  a  b  ", "\n", "a\nb\tc \r\n d", "▁", "a▁ b ▁c", "▁▁ x", "漢字 かな 🙂🙂 é é", "½ ﬁ ① ², ǅ",
    "don't we'll I'M <|endoftext|> x<|startoftext|>y </s> <s> <unk> <0x0A>", "\x00 \x01", " a b　", "ΑΣ ΟΔΟΣ İstanbul",
    "x" * 3000, "word " * 2000, "don't (o'rely) x,y 'tis '5s a1b22c <|EndOfText|> a<|b|>c é,é. e\u0301, ,\u0301 =\u0338x I\u0307 'S'RE rock'n'roll ''s .'s", "lorem ipsum dolor sit amet " * 400, "   \n\n  tail   ", "same text here", "same text here", "same  text\there",
    *_thue_morse(1024), *_thue_morse(2048),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, "clash") for i, t in enumerate(ODD_TEXTS)]
    rows += [(3, ODD_TEXTS[3], "s0", "clash"), (25, ODD_TEXTS[25], "s0", "clash")]  # repeated rows
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens string").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
