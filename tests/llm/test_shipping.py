"""Tasks carry the operators' functions and broadcasts with them: executors need no copy of the package."""

from tests.test_shipping import run_apart

CODE = """
from corpusloom.llm import decontamination, langid
docs = spark.createDataFrame([(1, "the house and the tree", "en"), (2, "das haus und der baum", "de")], "doc_id long, text string, lang string")
bench = spark.createDataFrame([("a", "the house"), ("b", "and the")], "item_id string, text string")
print(sorted((r.doc_id, r.n_hit) for r in decontamination.scan(docs, bench, ["doc_id"]).collect()))
print(sorted((r.doc_id, r.lang_pred) for r in langid.identified(docs, langid.train(docs), ["doc_id"]).collect()))
"""


def test_op1_and_op2_run_without_the_package_on_executors(tmp_path):
    assert run_apart(CODE, tmp_path).splitlines() == ["[(1, 4), (2, 0)]", "[(1, 'en'), (2, 'de')]"]
