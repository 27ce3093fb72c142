"""Literal cases of the hybrid fold, and the fold against a plain loop on random candidates."""

import random

import pytest

from reelquery.operators import hybrid

SCHEMA = (
    "query_id int, input_order int, asset_id string, file_id string, media_type string, "
    "path string, scene_id string, start_s double, end_s double, best_frame_s double, "
    "reasons array<string>, source_scores map<string,double>"
)


def cand(asset, start, end, scores, reasons, scene=None, file="f", media="video"):
    return dict(asset_id=asset, file_id=file, media_type=media, path=f"/{file}", scene_id=scene,
                start_s=start, end_s=end, best_frame_s=None, reasons=reasons, source_scores=scores)


def frame(spark, cases):
    rows = [
        {"query_id": 1, "input_order": i, **c} for i, c in enumerate(cases)
    ]
    return spark.createDataFrame([tuple(r[k.split()[0]] for k in SCHEMA.split(", ")) for r in rows],
                                 SCHEMA)


def run(spark, cases, **page):
    found = hybrid.page(hybrid.hybrid_results(frame(spark, cases)), **page)
    return found.orderBy("position").collect()


FRAME = {"video_frame_vectors": 0.5}
V, T, CAP = ["vector_match"], ["transcript_match"], ["caption_match"]


def test_overlapping_windows_and_transcript_become_one(spark):
    found = run(spark, [
        cand("a", 10.0, 20.0, {"video_frame_vectors": 0.42}, V),
        cand("b", 21.0, 30.0, {"video_frame_vectors": 0.84}, V),
        cand("c", 18.0, 28.0, {"text_search": 0.5}, T),
    ])
    assert [(r.asset_id, r.start_s, r.end_s, r.merged_asset_ids) for r in found] == [
        ("b", 10.0, 30.0, ["a", "b", "c"])
    ]
    assert found[0].reasons == ["vector_match", "transcript_match"]


def test_scores(spark):
    two = run(spark, [cand("a", 0.0, 5.0, {"image_vectors": 0.82, "text_search": 2.0},
                           ["vector_match", "transcript_match"])])
    assert two[0].score == pytest.approx(0.82 * 0.55 + (2 / 3) * 0.45 + 0.08)
    assert two[0].primary_reason == "vector_match"
    one = run(spark, [cand("a", 0.0, 5.0, {"image_vectors": 0.82}, V)])
    assert one[0].score == pytest.approx(0.82)


def test_caption_and_frame_of_a_scene(spark):
    found = run(spark, [
        cand("c", 0.0, 10.0, {"caption_text_vectors": 0.8}, CAP, scene="s1"),
        cand("f", 0.0, 10.0, {"video_frame_vectors": 0.7}, V, scene="s1"),
    ])
    assert len(found) == 1 and found[0].score == pytest.approx(0.83)
    assert found[0].primary_reason == "caption_match"


def test_weak_frame_does_not_lower_a_strong_caption(spark):
    found = run(spark, [
        cand("o", 20.0, 30.0, {"caption_text_vectors": 0.7354491}, CAP, scene="s2"),
        cand("c", 0.0, 10.0, {"caption_text_vectors": 0.80291784}, CAP, scene="s1"),
        cand("f", 0.0, 10.0, {"video_frame_vectors": 0.14920491}, V, scene="s1"),
    ])
    assert found[0].asset_id == "c" and found[0].score == pytest.approx(0.80291784)


def test_weak_vector_is_dropped_and_text_is_exempt(spark):
    found = run(spark, [
        cand("v", 0.0, 5.0, {"video_frame_vectors": 0.04}, V),
        cand("t", 50.0, 60.0, {"text_search": 0.1}, T),
    ])
    assert [r.asset_id for r in found] == ["t"]


@pytest.mark.parametrize("cases", [
    [cand("a", 0.0, 10.0, {"caption_text_vectors": 0.5}, CAP),
     cand("b", 5.0, 20.0, {"caption_text_vectors": 0.5}, CAP)],
    [cand("a", 0.0, 10.0, FRAME, V), cand("b", 10.0, 20.0, FRAME, V)],
    [cand("a", 0.0, 10.0, FRAME, V), cand("b", 5.0, 5.0, FRAME, V)],
    [cand("a", 0.0, 10.0, FRAME, V, scene="s1"), cand("b", 5.0, 20.0, FRAME, V, scene="s2")],
    [cand("a", 0.0, 10.0, FRAME, V), cand("b", 5.0, 20.0, FRAME, V, file="g")],
])
def test_windows_that_stay_apart(spark, cases):
    assert len(run(spark, cases)) == 2


def test_scene_keeps_its_bounds(spark):
    found = run(spark, [
        cand("t", 5.0, 25.0, {"text_search": 1.0}, T),
        cand("f", 10.0, 20.0, FRAME, V, scene="s1"),
        cand("u", 21.0, 24.0, {"text_search": 1.0}, T),
    ])
    assert [(r.scene_id, r.start_s, r.end_s) for r in found if r.scene_id] == [("s1", 10.0, 20.0)]
    assert len(found) == 2


@pytest.mark.parametrize("scores", [{"video_frame_vectors": 0.01}, FRAME])
def test_reversed_window_fails(spark, scores):
    with pytest.raises(Exception, match="invalid video time range"):
        run(spark, [cand("a", 10.0, 5.0, scores, V)])


def test_conflicting_scene_bounds_fail(spark):
    with pytest.raises(Exception, match="conflicting boundaries"):
        run(spark, [cand("a", 0.0, 10.0, FRAME, V, scene="s"),
                    cand("b", 0.0, 12.0, FRAME, V, scene="s")])


def test_page_is_cut_after_merging(spark):
    found = run(spark, [
        cand("a", 0.0, 10.0, {"video_frame_vectors": 0.9}, V),
        cand("b", 9.0, 20.0, {"video_frame_vectors": 0.85}, V),
        cand("c", 100.0, 110.0, {"video_frame_vectors": 0.8}, V),
    ], limit=1, offset=1)
    assert [r.asset_id for r in found] == ["c"]


def test_same_asset_takes_the_larger_score_per_source(spark):
    found = run(spark, [
        cand("a", None, None, {"image_vectors": 0.4}, V, media="image"),
        cand("b", None, None, {"image_vectors": 0.5}, V, media="image"),
        cand("a", None, None, {"caption_text_vectors": 0.6}, CAP, media="image"),
    ])
    assert [(r.asset_id, r.source_scores) for r in found] == [
        ("a", {"image_vectors": 0.4, "caption_text_vectors": 0.6}), ("b", {"image_vectors": 0.5})
    ]


# --- the fold against a plain loop -------------------------------------------------------------

WEIGHT = {"text_search": 0.45}


def norm(source, score):
    if source == "text_search":
        return 0.0 if score <= 0 else score / (score + 1)
    return min(1.0, max(0.0, score))


def loop_fold(cases):
    """Bounds and members per result, by the rules as stated in the operator's documentation."""
    live = [dict(c, members=[c["asset_id"]],
                 strength=max(WEIGHT.get(s, 0.55) * norm(s, v) for s, v in c["source_scores"].items()))
            for c in cases]
    by_file = {}
    for c in sorted(live, key=lambda c: c["start_s"]):
        by_file.setdefault(c["file_id"], []).append(c)
    results = []
    for items in by_file.values():
        done = []
        for c in items:
            if done and joins(done[-1], c):
                done[-1] = joined(done[-1], c)
            else:
                done.append(c)
        results += done
    return sorted(str((r["file_id"], r["scene_id"], r["start_s"], r["end_s"], r["asset_id"],
                       sorted(r["members"]))) for r in results)


def joins(a, b):
    if a["scene_id"] and b["scene_id"]:
        return a["scene_id"] == b["scene_id"]
    if set(a["source_scores"]) == set(b["source_scores"]) == {"caption_text_vectors"}:
        return False
    return max(a["start_s"], b["start_s"]) < min(a["end_s"], b["end_s"])


def joined(a, b):
    strong = b if b["strength"] > a["strength"] else a
    owner = None
    if a["scene_id"] and a["scene_id"] == b["scene_id"]:
        owner = b if a["end_s"] <= a["start_s"] < b["end_s"] and b["end_s"] > b["start_s"] else a
    elif a["scene_id"] and not b["scene_id"]:
        owner = a
    elif b["scene_id"] and not a["scene_id"]:
        owner = b
    scores = dict(a["source_scores"])
    for s, v in b["source_scores"].items():
        scores[s] = max(scores.get(s, v), v)
    return dict(
        a, asset_id=strong["asset_id"], source_scores=scores, members=a["members"] + b["members"],
        strength=max(a["strength"], b["strength"]),
        scene_id=owner["scene_id"] if owner else None,
        start_s=owner["start_s"] if owner else min(a["start_s"], b["start_s"]),
        end_s=owner["end_s"] if owner else max(a["end_s"], b["end_s"]),
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_equals_loop(spark, seed):
    rng = random.Random(seed)
    cases = []
    for i in range(120):
        file = f"f{rng.randint(0, 5)}"
        scene_no = rng.randint(0, 3)
        source = rng.choice(["video_frame_vectors", "caption_text_vectors", "text_search"])
        score = round(rng.uniform(0.2, 1.0), 3)
        reason = {"text_search": T, "caption_text_vectors": CAP}.get(source, V)
        if source == "text_search" or rng.random() < 0.3:
            start = round(rng.uniform(0, 40), 2)
            cases.append(cand(f"a{i:03d}", start, start + rng.choice([0.0, 3.0, 9.0]),
                              {source: score}, reason, file=file))
        else:
            cases.append(cand(f"a{i:03d}", scene_no * 10.0, scene_no * 10.0 + 10, {source: score},
                              reason, scene=f"{file}-s{scene_no}", file=file))
    found = hybrid.hybrid_results(frame(spark, cases)).collect()
    got = sorted(str((r.file_id, r.scene_id, r.start_s, r.end_s, r.asset_id,
                      sorted(r.merged_asset_ids))) for r in found)
    assert got == loop_fold(cases)
