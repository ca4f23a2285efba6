"""Workflows are brought up to date line by line, and once."""

from quillspar.operators.workflows import Tool, migrated, migrated_workflow
from quillspar.plans.facts import _TOOL

STEP = "      - name: Generate Documentation\n"


def test_variables_go_before_the_command():
    got = migrated(STEP + "        run: npx tool x", Tool("tool", "t", ("A", "B"), (("C", "d"),)))
    assert got.split("\n") == ["      - name: Generate Documentation", "        env:", "          A: ${{ secrets.A }}", "          B: ${{ secrets.B }}", "          C: d", "        run: npx t@latest x"]


def test_settings_follow_the_last_variable():
    tool, content = Tool("tool", "t", ("A", "B"), (("C", "d"),)), "env:\n    A: ${{ secrets.A }}\n    B: ${{ secrets.B }}\nrun: x"
    assert migrated(content, tool) == "env:\n    A: ${{ secrets.A }}\n    B: ${{ secrets.B }}\n    C: d\nrun: x"
    assert migrated(content.replace("    B: ${{ secrets.B }}\n", ""), tool) == content.replace("    B: ${{ secrets.B }}\n", "")


def test_installs_stay_in_scripts_of_others():
    content = "run: |\n  cd tools/tool\n  npm ci\n  npx tool x\nb:\n  run: |\n    npm ci\n    npm test\n"
    assert migrated(content, Tool("tool", "t")) == "run: |\n  npx t@latest x\nb:\n  run: |\n    npm ci\n    npm test\n"


def test_a_second_time_changes_nothing_and_edges(spark):
    content = "steps:\n  - name: Checkout repository\n    uses: actions/checkout@v3\n" + STEP + "        run: |\n          cd tools/tool\n          npm install\n          npx tool x\n"
    once = migrated(content, _TOOL)
    assert migrated(once, _TOOL) == once and "setup-node" in once and "PAGE_TOKEN" in once
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "no workflow\n" * 1000)], "id int, content string")
    got = {r.id: r.c for r in rows.select("id", migrated_workflow(rows.content, _TOOL).alias("c")).collect()}
    assert got == {1: None, 2: "", 3: "no workflow\n" * 1000}
