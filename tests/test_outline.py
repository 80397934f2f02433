from codelode.operators import outline


def previews(spark, make, text, language, most=None):
    lines = spark.createDataFrame([("f", k, t) for k, t in enumerate(text.split("\n"), 1)], "file string, line int, text string")
    spans = spark.createDataFrame([("f", "s", language, 1, text.count("\n") + 1)], "file string, name string, language string, start_line int, end_line int")
    row = (make(lines, spans) if most is None else make(lines, spans, most)).first()
    return row.preview, row.hidden


def test_skeletons_of_containers(spark):
    rust = "impl A {\n    /// said\n    pub fn one(&self) -> u8 {\n        let x = 1;\n        x\n    }\n    fn two() { 2 }\n    const N: u8 = 3;\n}"
    assert previews(spark, outline.skeletons, rust, "Rust") == ("impl A {\n    pub fn one(&self) -> u8 {\n    fn two() { 2 }\n    const N: u8 = 3;\n}", 5)
    python = "class B:\n    def f(self):\n        if x:\n            return 1\n    async def g(self): ..."
    assert previews(spark, outline.skeletons, python, "Python") == ("class B:\n    def f(self):\n    async def g(self): ...\n}", 2)
    assert previews(spark, outline.skeletons, "struct C {\n  x: u8,\n}", "Rust") == ("struct C {", 2)


def test_structure_of_functions(spark):
    go = "func f(n int) {\n\t// if\n\tx := 1\n\tfmt.Print(x)\n\tfor i := range n {\n\t}\n\treturn x\n}"
    assert previews(spark, outline.structures, go, "Go") == ("func f(n int) {\n\tx := 1\n\tfor i := range n {\n\treturn x\n}", 3)
    assert previews(spark, outline.structures, go, "Go", 2) == ("func f(n int) {\n\tx := 1\n}", 5)
    assert previews(spark, outline.structures, "def f():\n    # if:\n    x = 1\n    while x:\n        x -= 1\n    raise E", "Python") == ("def f():\n    while x:\n    raise E", 3)
    assert previews(spark, outline.structures, "function f() {\n  call();\n  await g();\n}", "JavaScript") == ("function f() {\n  await g();\n}", 1)
    assert previews(spark, outline.structures, "sub f {\n  my $x;\n  return 1;\n}", "Perl") == ("sub f {\n  return 1;\n}", 1)
