import numpy as np

from auditlake.llm import bilstm, op3_pii


def spans_of(tags):
    out, s = set(), 0
    while s < len(tags):
        if tags[s] == 0:
            s += 1
            continue
        k, e = (tags[s] - 1) // 2, s + 1
        while e < len(tags) and tags[e] == 2 + 2 * k:
            e += 1
        out.add((int(k), s, e))
        s = e
    return out


def test_gradient_is_right():
    x, tags = bilstm.arrays(bilstm.examples(6, 1))
    x, tags = x[:, :9], tags[:, :9]
    t = bilstm.Tagger(hidden=3)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    _, grad = t.gradient(x, tags)
    r = np.random.default_rng(0)
    for k, v in t.p.items():
        for _ in range(4):
            at = tuple(r.integers(0, n) for n in v.shape)
            old, eps, two = v[at], 1e-2, []
            for d in (eps, -eps):
                v[at] = old + d
                two.append(t.gradient(x, tags)[0])
            v[at] = old
            assert abs((two[0] - two[1]) / (2 * eps) - grad[k][at]) < 2e-2 * max(1, abs(grad[k][at])), k


def test_held_out_accuracy():
    x, tags = bilstm.arrays(bilstm.examples(600, 999))
    got, _ = bilstm.trained().decode(x)
    right = found = true = 0
    for a, b in zip(got, tags):
        f, t = ({s for s in spans_of(z) if s[1] > 0 and s[2] < bilstm.WINDOW} for z in (a, b))
        right, found, true = right + len(f & t), found + len(f), true + len(t)
    print(right, found, true)
    assert right > 0.9 * found and right > 0.9 * true


def test_windows_cover_every_trigger():
    text = "a" * 500 + "1" + "b" * 30 + "2" * 300 + " c" * 200 + "@" + "d" * 10
    at = op3_pii.windows(text)
    for m in op3_pii.TRIGGER.finditer(text):
        assert any(a <= m.start() < a + bilstm.WINDOW for a in at)


def test_spans(spark, sf):
    rows = [(1, None), (2, ""), (3, "é mail bob.x@site1.example.com, ip 10.0.0.256 or 10.0.0.25 and 4111 1111 1111 1111 +1 (216) 555-4155"), (4, "plain words 12 and 2024-01-02 v1.2.3"), (5, "x " * 50000 + "call (216) 555-4155 now"), (5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = op3_pii.personal_data(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6
    assert (by[3].n_email, by[3].n_ip, by[3].n_card, by[3].n_phone) == (1, 1, 1, 1)
    assert by[3].spans.startswith("email:7:30,ip:49:58,card:")
    assert by[4].spans == "" and by[2].spans == ""
    assert {r.spans for r in got if r.doc_id == 5} == {"phone:100005:100019", ""}
    assert op3_pii.personal_data(docs.limit(0)).count() == 0
    real = op3_pii.op3_pii(spark, sf).collect()
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in real) > 0
    print([r.spans for r in real if r.n_added])
