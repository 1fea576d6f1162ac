import random

import pytest

WORDS = {
    "en": "the of and to in that was his he it with is for as had you not be her on at by which have or from this him but all she they were my are me one their so an said them we who would been will no when there if more out up into do any your what has man could other than our some very time upon about may its only now like little then can should made did us such great before must two these see know over much down after first mr good men".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom können schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei diese dieser wieder keine uhr seiner worden will zwischen immer millionen".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se le ce il sont la les ou avec son il aux d'un en cette d'une ont ses mais comme on tout nous sa mais fait été aussi leur bien peut ces y deux ans encore n'est marché d entre même sous fois ainsi contre être sans très avait où depuis trois premier elle autres après toute leurs".split(),
}


COLUMNS = "doc_id long, text string, lang string, kept string, score double, word string, rep int, _id string, _gone int, _lang string, lang_found string, rules string, fp array<int>"


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang): prose, copies, edited copies, and the odd rows that every operator must bear."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, sentence(rng, lang, rng.randint(40, 90)), lang))
    for i in range(60, 72):
        rows.append((i, rows[i % 6][1], rows[i % 6][2]))
    for i in range(72, 90):
        words = rows[i % 9][1].split()
        words[rng.randrange(len(words))] = f"edit{i}"
        rows.append((i, " ".join(words), rows[i % 9][2]))
    rows += [
        (100, None, "en"),
        (101, "", "en"),
        (102, " \n\t ", None),
        (103, "one", "en"),
        (104, "one two", None),
        (105, "one two", "en"),
        (106, sentence(rng, "en", 30_000), "en"),
        (107, "x" * 200_000, "en"),
        (108, "  doubled  spaces and   odd\x0bbreaks\r\n ünïcödé 日本語 🤦🏼‍♂️ ", "de"),
        (109, rows[0][1], rows[0][2]),
        (109, rows[0][1], rows[0][2]),
        (110, "12345 ... !!!", "en"),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names clash with the operators' own."""
    rows = [(i, t, lang, "kept", 1.0, "block", 7, "a", 1, "b", "c", "d", [1]) for i, t, lang in corpus]
    return spark.createDataFrame(rows, COLUMNS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
