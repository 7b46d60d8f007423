import random

from auditlake.llm import op7_secrets

ALPHA = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
FORMS = [
    "credential={}", "export AWS_SECRET_ACCESS_KEY={}", 'client="{}"', "https://files.example.org/get?sig={}&part=2", "x.y={}== ok",
    "https://files.example.org/shared_link-a/{}/index-page_b.html", "backup+old/{}_copy-x",
]


def test_names_parameters_and_paths(spark):
    """Keys right after a sign, in a URL's parameters or joined with other words are spans of their own."""
    r, rows, want = random.Random(6), [], {}
    for i in range(70):
        key = "".join(r.choice(ALPHA) for _ in range(40))
        text = "the line " + FORMS[i % 7].format(key) + " ends"
        rows.append((i, text))
        want[i] = (text.index(key), text.index(key) + 40 + 2 * (i % 7 == 4))
    rows += [(1000 + i, "some_long_variable_name=other_long_variable_name_2 a=b c/d-e_f/2024/the-index_of-pages/and+more_of-them1 n=1") for i in range(30)]
    got = {x.doc_id: x for x in op7_secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for form in range(7):
        assert sum([(x.start, x.end) for x in got[i].added] == [want[i]] for i in range(form, 70, 7)) >= 8, FORMS[form]
    assert not any(got[1000 + i].added for i in range(30))


def test_padding_only_at_the_end():
    tokens = lambda t: [m.group() for m in op7_secrets.TOKEN.finditer(t)]
    a, b = "A1" * 10, "B2" * 11
    assert tokens(f"{a}={b} {a}== {a}=== {a}") == [a, b, a + "==", a, a]
