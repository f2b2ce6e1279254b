from pyspark.sql import functions as F

from tidegauge.operators import scoring


def test_a_message_is_flattened_once_however_many_attributes_are_read(spark):
    rows = [(1, "um com 20 anos, Alemanha, 2 produtos, inativo e outro com 45 anos, ativo, mesmo cliente"), (2, "score 700"), (3, None)]
    found = scoring.comparison_payloads(spark.createDataFrame(rows, "id int, said string"), "said")
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the halves, the three flat texts and the description
    assert plan.count("regexp_replace") <= 8
    one, two, three = found.orderBy("id").select("baseline.*", F.col("improved.Age").alias("later"), F.col("improved.NumOfProducts").alias("more")).collect()
    assert (one.Age, one.Geography, one.NumOfProducts, one.IsActiveMember, one.later, one.more) == (20, "Germany", 2, 0, 45, 2)
    assert (two.CreditScore, two.Age, two.later) == (700, 40, None)
    assert (three.CreditScore, three.Geography) == (600, "France")
