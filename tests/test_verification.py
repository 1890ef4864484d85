from sparkevidence.operators import verification

ANSWER, ITEM = "conv long, turn long, mode string, text string", "conv long, item long, title string, url string, text string"


def verified(spark, answers, evidence):
    out = verification.verified_answers(spark.createDataFrame(answers, ANSWER), spark.createDataFrame(evidence, ITEM), ["conv", "turn"], "conv", "item")
    return {(r["conv"], r["turn"]): (r["unsupported"], r["leakage"], r["verdict"], r["safe_answer"]) for r in out.collect()}


def test_support_leakage_and_safe_answers(spark):
    evidence = [(1, 1, "Backup handbook", "https://example.org/backup", "The nightly backup writes snapshots to the second disk. Restores need the admin password."), (1, 2, "Other page", None, "Snapshots older than thirty days are deleted."), (2, 1, None, None, None)]
    good, bad = "The nightly backup writes snapshots.", "Elephants enjoy swimming across wide rivers."
    answers = [
        (1, 1, "answer_from_materials", good), (1, 2, "answer_from_materials", f"{good} {bad}"), (1, 3, "answer_from_materials", bad), (1, 4, "answer_from_materials", f"{good}\nSources: page 3"), (1, 5, None, f"{good} It is told in the Backup handbook."),
        (1, 6, "out_of_base", bad), (1, 7, "answer_from_materials", None), (1, 8, "answer_from_materials", "See https://example.org/backup now"), (2, 1, "answer_from_materials", good), (3, 1, "answer_from_materials", "Yes. No."), (1, 9, "answer_from_materials", "Note these things:\n" + good),
    ]
    got = verified(spark, answers, evidence)
    assert got[1, 1] == (0, False, "pass", good) and got[1, 2] == (1, False, "rewrite", good) and got[1, 3] == (1, False, "fail", "")
    assert got[1, 4] == (0, True, "rewrite", good) and got[1, 5][1:3] == (True, "rewrite") and got[1, 6] == (0, False, "pass", bad) and got[1, 7] == (0, False, "pass", "")
    assert got[1, 8][1] and got[2, 1] == (1, False, "fail", "") and got[3, 1] == (0, False, "pass", "Yes. No.") and got[1, 9][2] == "pass"


def test_one_item_has_to_support(spark):
    """Stems that are spread over several items support nothing."""
    got = verified(spark, [(1, 1, "x", "alpha beta gamma delta epsilon zeta")], [(1, i, None, None, w) for i, w in enumerate(["alpha beta", "gamma delta", "epsilon zeta"])])
    assert got[1, 1][0] == 1
    assert verified(spark, [(1, 1, "x", "alpha beta gamma delta epsilon zeta")], [(1, 1, None, None, "alpha gamma zeta")])[1, 1][2] == "pass"
