from tidemark.params import Energy
from tidemark.sources import config


def test_first_readable_file_wins(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{oops")
    (tmp_path / "good.json").write_text('{"threshold": 0.3, "smooth": "x", "other": 1}')
    got = config.read_config(spark, [str(tmp_path / "none.json"), str(tmp_path / "bad.json"), str(tmp_path / "good.json")])
    assert got["threshold"] == 0.3
    assert config.apply(Energy(), got) == Energy(threshold=0.3)
    assert config.read_config(spark, [str(tmp_path / "none.json")]) == {}


def test_roots_and_paths(monkeypatch):
    monkeypatch.delenv("TRAINING_DATA_ROOT", raising=False)
    assert config.data_root("/d") == "/d"
    monkeypatch.setenv("TRAINING_DATA_ROOT", "/e")
    assert config.data_root("/d") == "/e"
    assert config.resolve("a/b", "/r") == "/r/a/b" and config.resolve("/a", "/r") == "/a" and config.resolve("hdfs://x/a", "/r") == "hdfs://x/a"


def test_a_model_is_written_back(spark, tmp_path):
    (tmp_path / "first.json").write_text('{"mad_k": 7.0, "logreg_model": null}')
    target = str(tmp_path / "settings")
    model = {"type": "binary", "weights": [0.5, -1.0], "bias": 0.1, "mean": [0.0, 0.0], "std": [1.0, 1.0]}
    for paths in ([str(tmp_path / "first.json")], [target]):
        config.write_setting(spark, paths, "logreg_model", model, target)
        assert config.read_config(spark, [target]) == {"mad_k": 7.0, "logreg_model": model}
