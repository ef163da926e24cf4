import numpy as np

from stratavox.__main__ import load_transforms, main, make_project
from stratavox.plans.config import Config
from stratavox.plans.engine import Engine
from test_engine import CONFIG, image
from test_volumes import blocks_of


def test_project_folder_and_steps(spark, tmp_path, capsys):
    root = str(tmp_path / "p")
    assert Config.read(make_project(root)) == Config()
    Config.from_dict(CONFIG).write(f"{root}/config.yaml")
    assert Config.read(make_project(root)) == Config.from_dict(CONFIG)  # kept
    Engine(spark, root, Config.from_dict(CONFIG)).catalog.write("raw", blocks_of(spark, image(), (12, 12, 12)))
    main(["run", root, "--steps", "tophat_filter,dog_filter"])
    assert capsys.readouterr().out.split() == ["tophat_filter", "dog_filter"]
    main(["run", root, "--steps", "tophat_filter"])
    assert capsys.readouterr().out.split() == []


def test_transforms_in_natural_order(spark, tmp_path):
    for name, shift in (("TransformParameters.10.txt", 10), ("TransformParameters.2.txt", 2), ("other.txt", 0)):
        (tmp_path / name).write_text(f'(Transform "AffineTransform")\n(TransformParameters 1 0 0 0 1 0 0 0 1 {shift} 0 0)\n(CenterOfRotationPoint 0 0 0)\n')
    assert [t(np.zeros((1, 3)))[0, 0] for t in load_transforms(spark, str(tmp_path))] == [2, 10]
