"""python -m tesserine COMMAND: evaluate, train, score, predict, curve, matrix, scan, search, search-scan, debug, demo."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict, fields

from .plans import commands, matrix
from .session import get_session
from .sources import sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tesserine", description=__doc__)
    p.add_argument("command", choices=["evaluate", "train", "score", "predict", "curve", "matrix", "scan", "search", "search-scan", "debug", "demo"])
    p.add_argument("--model", choices=commands.MODELS, default="interval")
    p.add_argument("--config", help="a JSON file of settings")
    p.add_argument("--search", help="a JSON file with the result of a search")
    p.add_argument("--artifact", help="folder of a saved model")
    p.add_argument("--out", help="folder of the report")
    p.add_argument("--form", choices=["json", "csv"], default="json")
    p.add_argument("--report-out", help="where the report goes too, besides an artifact or --out")
    p.add_argument("--image", help="the image of a single prediction")
    p.add_argument("--show-sources", action="store_true", help="print where each setting came from")
    for f in fields(commands.Settings):
        kind = commands.blocks_of if f.name == "blocks" else {"int": int, "float": float, "float | None": float}.get(str(f.type), str)
        names = [f"--{f.name.replace('_', '-')}"] + (["--seeds"] if f.name == "matrix_seeds" else [])
        p.add_argument(*names, dest=f.name, type=kind)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = get_session()
    text = lambda path: "\n".join(r[0] for r in spark.read.text(path).collect()) if path else None
    call = {f.name: getattr(a, f.name) for f in fields(commands.Settings)}
    s, origin = commands.layered(call, text(a.config), text(a.search))
    if a.show_sources:
        print(json.dumps(origin))
    if a.command == "demo":
        print(commands.demo(spark))
        return
    one = lambda found: spark.createDataFrame([(json.dumps(found, default=str),)], "report string")
    outs = [x for x in (a.out, a.report_out) if x]
    only = [a.report_out] if a.report_out else []  # where --out is for other things
    if a.command == "evaluate":
        told = one(commands.evaluate(spark, a.model, s))
    elif a.command == "train":
        (commands.train_library if a.model in ("library", "binary") else commands.train_artifact)(spark, s, a.artifact)
        told, outs = one({"model": a.model, "artifact": a.artifact, "settings": asdict(s)}), only
        if not outs:
            return
    elif a.command == "score":
        told = commands.score_artifact(spark, s, a.artifact, a.model)
    elif a.command == "predict":
        if a.form == "csv":
            raise commands.ConfigError("a single prediction has no form as CSV")
        told = one(commands.predict_one(spark, s, a.artifact, a.image, a.model))
    elif a.command == "curve":
        told = spark.createDataFrame(commands.curve(spark, s))
    elif a.command == "matrix":
        numbers = lambda text: commands.listed(text, int)
        models, seeds = commands.listed(s.matrix_models) or ["interval", "library"], numbers(s.matrix_seeds) or [s.seed]
        features = commands.listed(s.matrix_features) or (["pixels", "combined"] if s.source in commands.IMAGE_SOURCES else None)
        rows = commands.run_matrix(
            spark, s, models, seeds, numbers(s.matrix_intervals), features, commands.listed(s.matrix_resize_modes), numbers(s.matrix_image_sizes), commands.listed(s.matrix_correction_modes)
        )
        for part, found in (("rows", rows), ("summaries", matrix.summarize(rows)), ("top_rows", matrix.top_rows(rows, s.matrix_top))):
            for out in outs:
                sinks.write_report(found, f"{out}/{part}", a.form)
            if not outs:
                for row in found.toJSON().toLocalIterator():
                    print(f'{{"{part}":{row}}}')
        return
    elif a.command == "search":
        told, outs = one(commands.search_libraries(spark, s, a.out)), only
    elif a.command == "search-scan":
        told, outs = one(commands.search_scans(spark, s, s.data, a.out)), only
    elif a.command == "debug":
        told, outs = one(commands.debug_bundle(spark, s, a.model, s.debug_out or a.out, a.artifact)), only
    else:
        told = one(commands.scan_report(spark, s, s.data))
    for out in outs:
        sinks.write_report(told, out, a.form)
    if not outs:
        for row in told.toJSON().toLocalIterator():
            print(row)


if __name__ == "__main__":
    main()
