import random

import pytest

WORDS = ("the of and to river stone light under winter paper garden music silver mountain bread "
         "window letter summer bridge forest market simple quiet number orange yellow").split()


def sentence(dice: random.Random, n: int) -> str:
    return " ".join(dice.choice(WORDS) + str(dice.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages and the usual odd cases."""
    dice = random.Random(5)
    base = [sentence(dice, dice.choice((3, 8, 60, 150, 400))) for _ in range(40)]
    passage = "\n".join(sentence(dice, 12) for _ in range(4))
    out = list(base)
    for k in range(12):
        words = base[k].split()
        words[len(words) // 2] = "changed"
        out.append(" ".join(words))
    out += [base[0], base[1].upper(), base[2] + " " + base[3]]
    out += [f"{sentence(dice, 30)}\n{passage}\n{sentence(dice, 30)}" for _ in range(8)]
    out += [None, "", " ", "\n\n\n\n", "a", "a b c d", "a b c d", "ÀÉÎ ñandú 東京 straße", "x" * 5000,
            "same line\n" * 30, "ab " * 700, "   \x0b\x1c tab\tend", "12 ½ ² 😀😀", "!!! ???"]
    out += [sentence(dice, 12000)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Two equal rows, a null id, and extra columns with names that operators use inside."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or ""), "x", "y", 7)
            for i, t in enumerate(texts)]
    rows.append(rows[5])
    rows.append((None, texts[6], None, None, None, "x", "y", 7))
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, "
        "label string, sid string, spots int").repartition(4)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("false")


def by_id(frame, *columns):
    """Sorted rows of the wanted columns, null ids first."""
    rows = [tuple(r) for r in frame.select("doc_id", *columns).collect()]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, repr(r)))
