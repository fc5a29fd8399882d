import json
import logging

from skein import cli
from skein.operators import partition
from skein.sources import sinks


def test_generated_graph_to_a_trained_run(spark, tmp_path, capsys):
    data, out = f"file://{tmp_path}/data", f"file://{tmp_path}/out"
    common = ["--data-dir", data, "--clients", "3", "--seed", "7"]
    assert cli.main(["train", *common, "--out", out, "--rounds", "2", "--hidden", "4", "--local-epochs", "1", "--synthetic", "--communities", "greedy"], spark) == 0
    assert partition.summary(spark, data)["num_nodes"] == 1000 and partition.load(spark, data).nodes.select("cid").distinct().count() == 3
    assert sinks.RunStore(spark, out).read_log().count() == 2
    assert cli.main(["summary", "--out", out], spark) == 0 and "best_round" in capsys.readouterr().out


def test_custom_graph_and_catalogue(spark, tmp_path, capsys):
    (tmp_path / "e.csv").write_text("a,b\n" + "".join(f"{i},{(i * 7 + 1) % 20}\n" for i in range(20)))
    (tmp_path / "f.json").write_text(json.dumps({str(i): [i % 3] for i in range(20)}))
    (tmp_path / "l.csv").write_text("n,kind\n" + "".join(f"{i},k{i % 2}\n" for i in range(20)))
    at = lambda name: f"file://{tmp_path}/{name}"
    base = ["custom", "--data-dir", f"file://{tmp_path}"]
    assert cli.main([*base, "--name", "own", "--edges", at("e.csv"), "--features", at("f.json"), "--labels", at("l.csv"), "--clients", "2"], spark) == 0
    assert partition.summary(spark, at("own"))["dataset"] == "own"
    assert cli.main(base, spark) == 1 and cli.main([*base, "--show-formats"], spark) == 0
    assert cli.main(["datasets", "--list"], spark) == 0 and cli.main(["datasets", "--all", "--data-dir", at("")], spark) == 0
    assert "Format A" in capsys.readouterr().out


def test_logger_is_made_once(tmp_path):
    logger = sinks.setup_logging("skein-test", logging.INFO, "run.log", str(tmp_path))
    assert sinks.setup_logging("skein-test") is logger and len(logger.handlers) == 2
    logger.info("hello")
    assert "hello" in (tmp_path / "run.log").read_text()
