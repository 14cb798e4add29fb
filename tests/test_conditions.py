"""Conditions against what Python says of them; those that raise, or are no conditions, fail with a reason."""

import json

import pytest

from trellium.operators import conditions

FINAL = {
    "orders": {"o1": {"status": "shipped", "qty": 3, "tags": ["a", "b"]}, "o2": {"status": "open", "qty": 0, "tags": []}}, "items": [{"qty": 1, "on": True}, {"qty": 5, "on": False}, {"qty": 2.5, "on": True}],
    "n": 3, "name": "Word", "flag": True, "none": None, "empty": [], "nested": [[1, 2], [3]],
}
INITIAL = {"n": 2, "orders": {}, "items": [{"qty": 1, "on": True}]}
SOURCES = [
    'final_state["orders"]["o1"]["status"] == "shipped"', 'final_state["n"] > initial_state["n"] and not final_state["none"]', "len(final_state['items']) == 3", "len(final_state['name']) >= 5",
    'any(x["qty"] > 4 for x in final_state["items"])', 'all(x["qty"] > 0 for x in final_state["items"] if x["on"] if x["qty"])', 'sum(x["qty"] for x in final_state["items"]) == 8.5', "sum(1 for x in final_state['items'] if x['on']) == 2",
    'len([x for x in final_state["items"] if x["qty"] >= 2]) == 2', '"o2" in final_state["orders"]', '"o3" not in final_state["orders"]', '"or" in final_state["name"]', 'final_state.get("gone") is None', 'final_state.get("gone", 7) == 7',
    '"b" in final_state["orders"]["o1"]["tags"]', "1 < final_state['n'] <= 3", 'final_state["gone"] == 1', 'final_state["flag"] or final_state["gone"]', 'final_state["gone"] or final_state["flag"]', 'final_state["n"] < final_state["name"]',
    'final_state["items"][-1]["qty"] == 2.5', 'final_state["items"][9]["qty"] == 2.5', "final_state['n'] + 1 == 4 and final_state['n'] * 2 - 1 == 5", "final_state['n'] % 2 == 1", 'all(o["qty"] >= 0 for o in final_state["orders"].values())',
    'any(k == "o2" for k in final_state["orders"].keys())', 'final_state["name"].lower().startswith("wo")', "final_state['n']", "final_state['items'] == initial_state['items']", "final_state['empty'] == []", "final_state['n'] in (1, initial_state['n'] + 1)", "final_state['n'] in [1, final_state['gone']]", "unknown > 1", "unknown(final_state)",
    'any(any(y == 3 for y in x) for x in final_state["nested"])', "final_state['none'] is None", "final_state['flag'] is True", "not final_state['empty']", 'any(x["gone"] for x in final_state["items"])', "abs(initial_state['n'] - 5) == 3",
    "def check_func(final_state):\n    'doc'\n    return final_state['n'] == 3", "def check_func(final_state):\n    x = 1\n    return x == 1", "import os", "__import__('os').system('true')", "final_state.__class__ == 1", "lambda: 1", "",
    "any(final_state['n'] == 3 or x['gone'] for x in final_state['items'])", "-final_state['n'] < 0", "final_state['n'] / 0 == 1",
]


def said(source):
    """What Python says of a condition that it can evaluate without calling anything; this runs the sources above, which are ours."""
    text = source if not source.startswith("def") else source.split("return ", 1)[1]
    try:
        value = eval(text, {"__builtins__": {}, "any": any, "all": all, "len": len, "sum": sum, "abs": abs, "final_state": FINAL, "initial_state": INITIAL})
    except NameError:
        return False, "NameError"
    except Exception:
        return False, "raised"
    return (value, None) if isinstance(value, bool) else (False, "NonBoolResult")


UNRUNNABLE = {"def check_func(final_state):\n    x = 1\n    return x == 1", "import os", "__import__('os').system('true')", "final_state.__class__ == 1", "lambda: 1", ""}


def test_conditions_are_what_python_says(spark):
    states = spark.createDataFrame([(json.dumps(FINAL), json.dumps(INITIAL))], "final_state string, initial_state string")
    got = {}
    for a in range(0, len(SOURCES), 12):
        got |= {r["item"]: r for r in conditions.run(states, {str(i): SOURCES[i] for i in range(a, min(a + 12, len(SOURCES)))}).collect()}
    for i, source in enumerate(SOURCES):
        r = got[str(i)]
        if source in UNRUNNABLE:
            assert not r["passed"] and r["error_type"] in ("SyntaxError", "NameError", "AttributeError"), source
            continue
        passed, error = said(source)
        assert r["passed"] is passed, source
        assert (r["error_type"] is None) == (error is None) and (error in (None, "raised") or r["error_type"] == error), source


@pytest.mark.parametrize("state", ["oops", "[1]", None, "null"])
def test_a_state_that_is_no_object_fails_every_check(spark, state):
    df = spark.createDataFrame([("t", state)], "t string, final_state string")
    found = conditions.run(df, {"a": "1 == 1", "b": "final_state['x'] == 1", "c": "initial_state['x'] == 1"}, initial=None)
    rows = found.collect()
    assert [(r["item"], r["passed"], r["error_type"]) for r in rows] == [("a", False, "TypeError"), ("b", False, "TypeError"), ("c", False, "NameError")]
    score = conditions.scores(found, ["t"]).first()
    assert (score["checks"], score["passed"], score["reward"], score["name_errors"]) == (3, 0, 0.0, 1)


ODD = {
    "": 1, " lead": 2, "it's": 3, "q?": 4, "x.y": 5, "a b": 6, "日本": 7, "[0]": 8, "0": 9, "deep": {"a": [{"b": [10, {"c": "z"}]}]}, "pick": "deep", "at": 0, "items": [{"qty": 1, "on": True}, {"qty": 5, "on": False}], "n": 3,
    "name": "Word", "flag": True, "none": None, "zero": 0, "blank": "", "half": 0.5,
}
BEFORE = {"n": 2, "items": [{"on": True, "qty": 1}], "name": "word"}
MORE = [
    "final_state[''] == 1", "final_state[' lead'] == 2", 'final_state["it\'s"] == 3', "final_state['q?'] == 4", "final_state['x.y'] == 5", "final_state['a b'] == 6", "final_state['日本'] == 7", "final_state['[0]'] == 8", "final_state['0'] == 9", "final_state[0] == 9",
    "final_state['deep']['a'][0]['b'][1]['c'] == 'z'", "final_state['deep']['a'][-1]['b'][0] == 10", "final_state['deep']['a']['b'] == 10", "final_state['deep']['a'][1] == 10", "final_state['deep'][0] == 10", "final_state['n']['a'] == 1", "final_state['items'][99999999999] == 1",
    "final_state[final_state['pick']]['a'][final_state['at']]['b'][0] == 10", "final_state['items'][initial_state['n'] - 1]['qty'] == 5", "final_state.get('deep').get('a')[0]['b'][0] == 10", "final_state['n'].get('a') is None", "final_state.get('none', 3) is None",
    "final_state['none'] == None", "final_state['n'] == None", "final_state['n'] != 'Word'", "final_state['name'] == 'Word'", "final_state['name'] != initial_state['name']", "final_state['flag'] == True", "final_state['gone'] != 1", "'a' == 1", "final_state['n'] == 3.0", "final_state['half'] == 0.5",
    "final_state['items'][0] == initial_state['items'][0]", "final_state['items'] != initial_state['items']", "final_state['n'] is None", "final_state['flag'] is not True", "final_state['n'] is not final_state['none']", "final_state['name'] < 'X'", "final_state['none'] < 1", "final_state['flag'] < 'a'", "'b' > final_state['n']",
    "final_state['n'] in [initial_state['n'] + 1]", "final_state['n'] in [initial_state['n'], 3]", "final_state['n'] not in [1, 'Word', None, True]", "final_state['none'] in [None]", "final_state['gone'] in [1, 2]", "final_state['n'] in [3, final_state['gone']]", "'a' in final_state['deep']", "'Wo' in final_state['name']", "1 in final_state['n']",
    "final_state['n'] in final_state['name']", "final_state['n'] and final_state['name']", "final_state['zero'] or final_state['flag']", "final_state['blank'] or final_state['none'] or final_state['n'] == 3", "final_state['gone'] or True", "True or final_state['gone']", "False and final_state['gone']",
    "(final_state['n'] == 3 and final_state['gone']) or True", "not (final_state['n'] == 4 and final_state['gone'])", "(final_state['n'] == 3 or final_state['gone']) and final_state['flag']", "1 < final_state['n'] < final_state['gone']", "5 < final_state['n'] < final_state['gone']",
    "any(x['qty'] == 1 for x in final_state['items'] if x['qty'] < 2 or x['gone'])", "any([x['qty'] == 1 for x in final_state['items'] if x['qty'] < 2 or x['gone']])", "any([x['qty'] == 1 or x['gone'] for x in final_state['items']])", "all(x['qty'] == 2 and x['gone'] for x in final_state['items'])",
    "all([x['qty'] > 0 for x in final_state['items']])", "any(x['qty'] > 9 for x in final_state['items'] if x['on'] if x['qty'])", "sum(x['on'] for x in final_state['items']) == 1", "sum(x['gone'] for x in final_state['items'] if not x['on']) == 1", "len([x for x in final_state['items'] if x['gone']]) == 1", "len([x for x in final_state['items']]) == 2",
    "all(x['n'] for x in final_state['none'])", "any(k == 'a' for k in final_state['deep'])", "len(final_state['n']) == 1", "len(final_state['deep']['a'][0]['b']) == len(final_state['deep']) + 1", "-final_state['half'] % 2 == 1.5", "abs(final_state['name']) == 1", "final_state['half'] * 2 == 1", "sum(y for y in [1, final_state['n']]) == 4",
    "[1, final_state['n']][1] == 3", "final_state", "None", "'a'", "1 + 1", "final_state['deep']", "final_state['none']", "final_state['name'].upper() == 'WORD'", "final_state['n'].upper() == 'WORD'", "final_state['name'].lower() == initial_state['name']",
]


def test_odd_conditions_are_what_python_says(spark):
    """All in one plan, which conditions that named their operands again and again were too large for."""
    states = spark.createDataFrame([(json.dumps(ODD), json.dumps(BEFORE))], "final_state string, initial_state string")
    got = {r["item"]: r for r in conditions.run(states, {source: source for source in MORE}).collect()}
    for source in MORE:
        try:
            value = eval(source, {"__builtins__": {}, "any": any, "all": all, "len": len, "sum": sum, "abs": abs, "final_state": ODD, "initial_state": BEFORE})
            want = (value, None) if isinstance(value, bool) else (False, "NonBoolResult")
        except Exception:
            want = (False, "LookupError")
        assert (got[source]["passed"], got[source]["error_type"]) == want, source


def test_a_state_is_parsed_once_and_a_path_is_one_step(spark):
    """The plan grows with the text of the conditions, not with the depth to the power of what a node names."""
    states = spark.createDataFrame([("{}", "{}")], "final_state string, initial_state string")

    def plan(*sources):
        return conditions.run(states, dict(enumerate(sources)))._jdf.queryExecution().optimizedPlan().toString()

    both = plan("final_state['a'] == 1", "final_state['a'] == initial_state['a']", "final_state['b'] > 2 and initial_state['b'] > 2")
    assert both.lower().count("parsejson") == 2
    shallow, deep = (plan("final_state" + "['a']" * n + " == 1") for n in (1, 5))
    assert len(deep) < 2 * len(shallow)
    chain = [plan(" and ".join(f"final_state['k'] > {i}" for i in range(n))) for n in (4, 16)]
    assert len(chain[1]) < 5 * len(chain[0])
