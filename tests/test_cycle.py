"""Roles, answering and the replay objective on small cases."""

from mnemos.operators import cycle, graph, roles


def test_role_rules(spark):
    row = [("t", {"prototype": 0.1}, {"prototype": 2.0}, {"prototype": 0.0}, 1.0, ["m"], ["p"]), ("u", {"prototype": 4.0}, {"prototype": 0.0}, {"prototype": 0.0}, 1.0, ["m"], []), ("v", None, None, None, 0.5, [], [])]
    df = spark.createDataFrame(row, "trace_id string, role_logits map<string,double>, role_support map<string,double>, role_gain_ema map<string,double>, fidelity double, member_ids array<string>, path_signature array<string>")
    got = {r["trace_id"]: r for r in roles.accept_decay(roles.accept_promotion(df), 1.0).collect()}
    assert got["t"]["promoted"] and abs(got["t"]["promote_delta"] - 0.03 * (1.7**2 - 1.9**2)) < 1e-12
    assert not got["u"]["promoted"] and got["u"]["demoted"]
    assert not got["t"]["demoted"] and not got["v"]["promoted"]
    assert roles.accept_decay(df, 1.2).where("demoted").count() == 3


def test_answers_become_linked_events(spark):
    cues = spark.createDataFrame([("c1", "s", "why?", 1.0), ("c2", "s", "what?", 2.0)], "cue_id string, session_id string, text string, ts double")
    spaces = spark.createDataFrame([("c1", ["t1"], [1.0]), ("c2", [], [])], "cue_id string, active_ids array<string>, weights array<double>")
    answers = spark.createDataFrame([("c1", "```md\nbecause\n```"), ("c2", "  ")], "cue_id string, answer string")
    prompts, events = cycle.respond_batch(cues, spaces, answers, "Be brief.")
    p = {r["cue_id"]: r["messages"] for r in prompts.collect()}
    assert p["c1"][0]["content"].startswith("Be brief.\n\nongoing_context:\n- trace:t1 weight=1.0000") and p["c2"][1]["content"] == "what?"
    assert "- none" in p["c2"][0]["content"]
    out = events.collect()
    assert [(r["payload"], r["source"], r["meta"]) for r in out] == [("because", "assistant", {"response_to": "why?"})]


def test_dangling_members_leave_with_their_alpha(spark):
    g = spark.createDataFrame([("g", ["a", "b", "c"], [1.0, 2.0, 3.0, 0.5]), ("h", ["b"], [4.0, 0.5])], "group_id string, member_ids array<string>, alpha array<double>")
    got = {r["group_id"]: (r["member_ids"], r["alpha"]) for r in graph.drop_dangling_members(g, spark.createDataFrame([("b",)], "trace_id string")).collect()}
    assert got == {"g": (["a", "c"], [1.0, 3.0, 0.5]), "h": ([], [0.5])}


def test_replay_objective_of_equal_activations_is_zero(spark):
    a = spark.createDataFrame([("f", "t", 0.7), ("f", "u", 0.3)], "frame_id string, trace_id string, a double")
    e = spark.createDataFrame([("t", "u", "temporal", 0.4, 1.0, 1.0)], "src string, dst string, kind string, weight double, success_alpha double, success_beta double")
    g = spark.createDataFrame([(0.2, 0.1)], "unresolved_mass double, replay_tension_ema double")
    one = spark.createDataFrame([("t",)], "trace_id string")
    r = cycle.replay_objective(a, a, e.select("src", "dst"), e, g, one.limit(0), one).first()
    assert abs(r["activation_kl"]) < 1e-12 and abs(r["transition_gap"] - 0.6) < 1e-12 and abs(r["group_heat"] - 0.2) < 1e-12 and r["churn"] == 0
