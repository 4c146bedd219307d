"""Small tables with every awkward case, for all operators."""

import random

import pytest

# names that operators use inside, as extra columns of the input
CLASHES = "key string, row string, g string, fp string, cut string, block string, start string, n_words string, kept string, _key string, _id string"


def _texts():
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdeéü") for _ in range(rnd.randint(1, 6))) for _ in range(60)]

    def prose(n):
        return " ".join(rnd.choice(words) + rnd.choice(["", "", "", ".", ",", "!"]) for _ in range(n))

    shared = prose(70)
    base = prose(120)
    near = base.split(" ")
    near[60] = "other"
    out = [prose(rnd.randint(0, 90)) for _ in range(25)]
    out += [base, base, " ".join(near), prose(10) + "\n" + shared + "\n" + prose(10), shared + "\n" + prose(30),
            prose(5) + " " + shared + " " + prose(5)]
    out += ["", " \n\t ", None, None, "one", "One two", "a b c", "ha " * 300, "x" * 900, "ab" * 700, "# * $ % & | < >",
            "line one is this one here\nline one is this one here\nLINE  one is this one HERE\n\n", "ﬁ ẞ İ     日本語 ’s it's",
            "<|endoftext|> is text", "tab\tand\x0bvertical\x0cfeed\rreturn", prose(9000)]
    return out


@pytest.fixture(scope="session")
def awkward(spark):
    texts = _texts()
    rows = [(i, t, None if i % 11 == 5 else f"host{i % 3}", "xx", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, texts[3], "host1", None, None), (None, None, None, None, None), (-5, texts[25], "host0", "a", 1)]
    rows = [(*r, *["clash"] * len(CLASHES.split(","))) for r in rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, lang string, n_chars long, {CLASHES}")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def items(spark, awkward):
    texts = _texts()
    rows = [(10, " ".join(texts[25].split(" ")[5:40])), (9, texts[28].split("\n")[1]), (9, "One"), (8, "two"), (7, None), (6, ""),
            (5, "?? !!"), (100, "ha " * 12), (11, " ".join(texts[25].split(" ")[5:40])), (12, "not in any of the texts at all, is it really not so")]
    return spark.createDataFrame([(*r, "clash") for r in rows], "item_id long, text string, key string")
