import re

from umbra.plans import privacy

#: Queries over customers, whose rows are few and dear.
DEALT = [
    "secret_map_long", "redact_category_totals", "protect_released", "protect_roundtrip", "secure_read", "python_ast_abstract", "protect_python", "forget_subject", "protect_own_pass",
    "mask_placeholders", "abstract_roundtrip", "secret_survival", "restore_roundtrip", "leak_gate_unmapped", "leak_gate_visible", "redact_text_built",
]
DEAR = re.compile(r"regexp_replace|regexp_extract|sha2|PythonUDF|ArrowEvalPython")


def test_customers_are_dealt_out_before_work(spark, sf_dir):
    """Nothing dear stands below the exchange that deals the one row group out: there it would be one task's work."""
    for name in DEALT:
        plan = privacy.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        depth = [len(re.match(r"[\s:+-]*", x).group()) for x in plan]
        dealt = [i for i, x in enumerate(plan) if "Repartition" in x]
        assert dealt, name
        for i in dealt:
            for j in range(i + 1, len(plan)):
                if depth[j] <= depth[i]:
                    break
                assert not DEAR.search(plan[j]), (name, plan[j][:200])


def test_redaction_is_made_once(spark, sf_dir):
    for name in ("secret_map_long", "redact_category_totals", "forget_subject"):
        plan = privacy.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace(") == 1, name
