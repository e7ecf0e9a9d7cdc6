"""Raw responses to a report: every task, marks, masks, annotations, filters and the command line."""

import json

import pytest

from evalloom.__main__ import main
from evalloom.plans import evaluate
from evalloom.sources import readers

FULL = [{"size": [10, 10], "counts": [0, 100]}]
LEFT = [{"size": [10, 10], "counts": [0, 50, 50]}]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """A folder with annotations and raw responses, and what each sample must score."""
    root = tmp_path_factory.mktemp("eval")
    cases = [
        # (folder, annotations, response, score, invalid)
        ("TargetLocalization/BasicAttributes/Color", {"masklet_target": LEFT, "count_target_instance": 2, "precise_count": True}, "{'number_of_objects': 2, 'bounding_boxes': [(0, 0, 5, 10)]}", 1.0, False),
        ("TargetLocalization/BasicAttributes/Color", {"masklet_target": LEFT, "count_target_instance": "4"}, "{'number_of_objects': 3, 'bounding_boxes': [(0, 0, 10, 10)]}", 0.7 * 0.5 + 0.3 * 0.75, False),
        ("TargetLocalization/BasicAttributes/Color", {"masklet_target": FULL, "count_target_instance": 0, "count_in_description": "yes"}, "{'number_of_objects': 0, 'bounding_boxes': []}", 1.0, False),
        ("TargetLocalization/EmbodiedCompositionalAttributes/Spoken", {"masklet_target": LEFT, "count_target_instance": 1}, "no answer", 0.0, True),
        ("Navigation/GroundDetection", {"masklet_ground": LEFT}, "{'bounding_boxes': [(0, 0, 0.5, 1)]}", 1.0, False),
        ("Navigation/VisualMatching", {"masklet_matching_area": LEFT, "count_matching_area": 1, "Precise_Count": True}, "{'number_of_instances': 2, 'bounding_boxes': [(0, 0, 5, 10)]}", 0.5, False),
        ("Navigation/FeasiblePath/FeasiblePath_Ego", {"masklet_path": FULL, "masklet_target_area": [{"size": [10, 10], "counts": [0, 10, 90]}]}, "{'points': [(5, 9), (4, 6), (2, 3), (0, 0)]}", None, False),
        ("Navigation/FeasiblePath/FeasiblePath_Exo", {"masklet_path": FULL, "masklet_target_area": LEFT}, "{'points': []}", 0.0, True),
        ("Manipulation/AffordanceRegion", {"masklet_affordance_region": []}, "{'bounding_boxes': []}", 1.0, False),
        ("Manipulation/ContactRelationship/ContactRelationship_TypeOne", {"masklet_contact_target": LEFT, "count_contact_target": 1}, "{'number_of_instances': 1, 'bounding_boxes': [(0, 0, 5, 10)]}", 1.0, False),
        ("Manipulation/PlacementRegion", {"masklet_placement_region": LEFT, "placement_feasible": "no"}, "{'bounding_boxes': [(0, 0, 5, 10)], 'placement_feasibility': False}", 1.0, False),
        ("Manipulation/PlacementRegion", {"masklet_placement_region": LEFT}, "{'bounding_boxes': [(0, 0, 5, 10)], 'placement_feasibility': True}", 0.5, True),
    ]
    lines = []
    for i, (folder, fields, response, _, _) in enumerate(cases):
        d = root / "data" / folder
        d.mkdir(parents=True, exist_ok=True)
        images = [f"{d}/{i}_image.jpg", f"{d}/b{i}_image.jpg"] if "Matching" in folder else [f"{d}/{i}_image.jpg"]
        name = f"{i}__b{i}_mask_rle.json" if "Matching" in folder else f"{i}_mask_rle.json"
        text = {k: v for k, v in fields.items() if not k.startswith("masklet")}
        (d / name).write_text(json.dumps({"text_annotation": text, "mask_annotation": {k: v for k, v in fields.items() if k.startswith("masklet")}}))
        lines.append(json.dumps({"images": [{"path": images[0]}, *images[1:]], "response": response}))
    (root / "raw.jsonl").write_text("\n".join([*lines, "broken", ""]))
    assert main(["format", str(root / "raw.jsonl"), "--out", str(root / "std")], spark) == 0
    return root, cases


def test_every_task(spark, run):
    root, cases = run
    e = evaluate.evaluate(spark, f"{root}/std", f"{root}/data")
    rows = {r.truth_path.split("/")[-1]: r for r in e.samples.collect()}
    assert len(rows) == len(cases)
    for i, (folder, _, _, score, invalid) in enumerate(cases):
        r = rows[f"{i}__b{i}_mask_rle.json" if "Matching" in folder else f"{i}_mask_rle.json"]
        assert score is None or abs(r.score - score) < 1e-9, (i, folder, r)
        assert r.invalid == invalid, (i, folder, r.error)
    assert rows["6_mask_rle.json"].score > 0.8 and rows["6_mask_rle.json"].score_details.weight_path == 1.0
    assert rows["4_mask_rle.json"].response_details.coordinate_system == "normalized_0_1"
    report = {(r.grain, r.key): r for r in e.report.collect()}
    assert report["overall", "overall"].total_processed == 12 and report["type", "TargetLocalization/BasicAttributes/Color"].total_processed == 3
    assert report["category", "Navigation"].num_invalid == 1 and ("type", "Manipulation/PlacementRegion") in report
    tally = evaluate.by_file(e).collect()
    assert sum(r.samples for r in tally) == 12 and sum(r.failed for r in tally) == 0


def test_filters_modes_and_mask_answers(spark, run, tmp_path):
    root, _ = run
    only = evaluate.evaluate(spark, f"{root}/std", f"{root}/data", group="EmbodiedCompositionalAttributes")
    assert only.samples.count() == 1
    forced = evaluate.evaluate(spark, f"{root}/std", f"{root}/data", kinds=["GroundDetection"], mode="absolute").samples.first()
    assert forced.score == 0.0 and forced.response_details.coordinate_system == "absolute"
    std = {"task_category": ["Navigation"], "task_type": ["GroundDetection"], "format_type": ["mask"], "coordinate_system": ["auto"], "ground_truth": {"masklet_ground": LEFT}}
    answers = [LEFT, FULL, [], [{"size": [5, 5], "counts": [0, 25]}], "No Valid Response", None]
    (tmp_path / "m.json").write_text(json.dumps([std | {"formatted_response_localization": a} for a in answers] + [5]))
    got = evaluate.evaluate(spark, str(tmp_path / "m.json"), whole=True).samples.orderBy("index").collect()
    assert [r.score for r in got] == [1.0, 0.5, 0.0, 0.0, 0.0, 0.0] and [r.invalid for r in got] == [False] * 4 + [True] * 2
    assert "does not match" in got[3].error


def test_traps_of_marks_and_missing_truth(spark, tmp_path):
    """Marks within lists aren't marks; missing masks are errors but not invalid; the mask of a path is looked at first."""
    box, gd = [[0, 0, 5, 10]], {"task_category": ["Navigation"], "task_type": ["GroundDetection"], "format_type": ["bbox"], "coordinate_system": ["auto"]}
    fp = gd | {"task_type": ["FeasiblePath_Ego"]}
    cases = [
        (gd | {"formatted_response_localization": ["No Valid Response"], "ground_truth": {"masklet_ground": []}}, 1.0, False, None),
        (gd | {"formatted_response_localization": ["No Valid Response"], "ground_truth": {"masklet_ground": FULL}}, 0.0, False, None),
        (gd | {"formatted_response_localization": box, "ground_truth": {"masklet_ground": [{"size": [10, 10], "counts": "\u0001"}]}}, 0.0, False, "GT mask is missing"),
        (gd | {"formatted_response_localization": [[2, 2, 7, 9]], "ground_truth": {"masklet_ground": []}}, 0.0, False, None),
        (gd | {"formatted_response_localization": [[10, 10, 5, 0], [0, 0, 1, 1e9]], "ground_truth": {"masklet_ground": LEFT}, "coordinate_system": ["absolute"]}, 10 / 100 * 1.0, False, None),
        (fp | {"formatted_response_path": ["No Valid Response"], "ground_truth": {"masklet_target_area": FULL}}, 0.0, False, "mask is missing"),
        (fp | {"formatted_response_path": ["No Valid Response"], "ground_truth": {"masklet_path": FULL}}, 0.0, True, "No path points parsed"),
        (fp | {"formatted_response_path": [[1, 1], [1.1, 1]], "ground_truth": {"masklet_path": FULL}}, 0.0, False, None),
        ({"task_category": ["Elsewhere"], "task_type": []}, 0.0, False, None),
        ({"task_category": "Navigation", "task_type": "FeasiblePath", "formatted_response_path": None, "ground_truth": {"masklet_path": FULL}}, 0.0, True, "No Valid Response"),
    ]
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps(c[0]) for c in cases))
    e = evaluate.evaluate(spark, str(tmp_path / "t.jsonl"))
    got = e.samples.orderBy("index").collect()
    for i, (r, (_, score, invalid, error)) in enumerate(zip(got, cases, strict=True)):
        assert abs(r.score - score) < 1e-9 and r.invalid == invalid and (error is None) == (r.error is None) and (error or "") in (r.error or ""), (i, r.score, r.invalid, r.error)
    assert got[3].response_details.coordinate_system == "normalized_0_1000"  # the canvas of an empty truth is one pixel
    report = {(r.grain, r.key): r.total_processed for r in e.report.collect()}
    assert report["overall", "overall"] == 10 and report["category", "Navigation"] == 9 and ("category", "Elsewhere") not in report and report["type", "Navigation/FeasiblePath/FeasiblePath_Ego"] == 3


def test_command_line(spark, run, tmp_path, capsys):
    root, _ = run
    assert main(["evaluate", f"{root}/std", "--annotations", f"{root}/data", "--out", str(tmp_path / "e"), "--family", "Claude"], spark) == 0
    head = spark.read.json(f"{tmp_path}/e/summary").first()
    assert head.summary.overall.total_processed == 12 and head.coord_override == "absolute"
    assert main(["evaluate", f"{root}/std", "--annotations", f"{root}/data", "--out", str(tmp_path / "l"), "--lines"], spark) == 0
    summary, samples = readers.result_log(spark, f"{tmp_path}/l")
    assert summary.count() == 1 and samples.count() == 12
    assert main(["evaluate", f"{root}/std", "--out", "x", "--dry-run"], spark) == 0 and main(["modes"]) == 0 and main(["scorers"]) == 0
    assert "Navigation/FeasiblePath_Exo" in capsys.readouterr().out
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text('{"image_path_saved": ["/d/1_image.jpg"], "text_annotation": {"text_label": ["red cup"]}}')
    assert main(["convert", str(tmp_path / "a"), "--task", "TargetLocalization", "--out", str(tmp_path / "p"), "--style", "cot", "--form", "json"], spark) == 0
    assert readers.json_records(spark, str(tmp_path / "p"), whole=True).count() == 1
