import pytest

from gleaner.operators import scores


def predictions(spark, pairs):
    return spark.createDataFrame(pairs, "label INT, pred INT")


def by_hand(pairs):
    classes = sorted({c for p in pairs for c in p})
    rows = {}
    for c in classes:
        hits = sum(a == c == b for a, b in pairs)
        said, real = sum(b == c for _, b in pairs), sum(a == c for a, _ in pairs)
        p, r = hits / said if said else 0.0, hits / real if real else 0.0
        rows[c] = (p, r, 2 * p * r / (p + r) if p + r else 0.0, real)
    return rows


CASES = [
    [(0, 0), (0, 1), (1, 1), (1, 1), (1, 0), (0, 0)],
    [(0, 1), (1, 0)],  # nothing right
    [(1, 1), (1, 1)],  # one class
    [(0, 2), (1, 1), (0, 0)],  # predicted class without support
]


@pytest.mark.parametrize("pairs", CASES)
def test_report_and_macro(spark, pairs):
    frame, want = predictions(spark, pairs), by_hand(pairs)
    report = {r["name"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in scores.classification_report(frame).collect()}
    for c, row in want.items():
        assert report[str(c)] == pytest.approx(row)
    n, accuracy = len(pairs), sum(a == b for a, b in pairs) / len(pairs)
    for i in range(3):
        assert report["macro avg"][i] == pytest.approx(sum(r[i] for r in want.values()) / len(want))
        assert report["weighted avg"][i] == pytest.approx(sum(r[i] * r[3] for r in want.values()) / n)
        assert report["accuracy"][i] == pytest.approx(accuracy)
    macro = scores.macro_metrics(frame).first()
    assert macro["f1_macro"] == pytest.approx(report["macro avg"][2]) and macro["accuracy"] == pytest.approx(accuracy)


def test_confusion_matrix_covers_the_grid(spark):
    got = {(r["label"], r["pred"]): r["n"] for r in scores.confusion_matrix(predictions(spark, CASES[3])).collect()}
    assert got == {(a, b): sum((a, b) == p for p in CASES[3]) for a in range(3) for b in range(3)}


def test_decision_is_strict(column):
    assert column([0.5, 0.5000001, 0.0], scores.binary_decision, "DOUBLE") == [0, 1, 0]
