from folioscope.functions.sql import register_sql
from folioscope.operators.chunking import register_chunker


def test_sql_names(spark):
    register_chunker("halves", replace=True)(lambda text: [(0, len(text) // 2), (len(text) // 2, len(text))])
    names = register_sql(spark, "token", "halves")
    assert names[:2] == ["chunk_token", "chunk_halves"]
    spark.createDataFrame([("d", "abcdef"), ("e", None)], "doc_id string, text string").createOrReplaceTempView("texts")
    got = spark.sql("""select doc_id, c.* from texts, lateral chunk_token(text, '{"chunk_size": 4}') c order by place""").collect()
    assert [(r.doc_id, r.start, r.end, r.content) for r in got] == [("d", 0, 4, "abcd"), ("d", 4, 6, "ef")]
    assert spark.sql("select c.content from texts, lateral chunk_halves(text, '') c where doc_id = 'd'").count() == 2
    row = spark.sql("select vector_dot(array(1D, 2D), array(3D, 4D)) d, vector_length(array(3D, 4D)) n, page_state(' ') s").first()
    assert (row.d, row.n, row.s) == (11.0, 5.0, "empty")
