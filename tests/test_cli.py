from brineloom import cli, config

SF = "/root/testdata/sf0.001"


def test_init_check_run_and_status(spark, tmp_path, capsys):
    c = str(tmp_path / "c.yaml")
    assert cli.main(["init", c]) == 0 and cli.main(["init", c]) == 1 and cli.main(["init", c, "--force"]) == 0
    assert config.load(c) == config.merged()
    assert cli.main(["check", c, SF]) in (0, 1)
    (tmp_path / "bad.yaml").write_text("loop: {kk: 1}")
    assert cli.main(["check", str(tmp_path / "bad.yaml"), SF]) == 1
    assert cli.main(["queries"]) == 0 and cli.main(["run", "agg24_kappa", SF, str(tmp_path)]) == 0
    assert cli.main(["status", str(tmp_path)]) == 0 and "agg24_kappa" in capsys.readouterr().out
