"""A small hand-written estate with the cases the tests look for."""

from __future__ import annotations

import json


def _doc(value) -> str:
    return json.dumps(value)


def lit(value: str) -> dict:
    return {"expr": {"Literal": {"Value": value}}}


def col(table: str, name: str) -> dict:
    return {"Column": {"Expression": {"SourceRef": {"Entity": table}}, "Property": name}}


def measure(table: str, name: str) -> dict:
    return {"Measure": {"Expression": {"SourceRef": {"Entity": table}}, "Property": name}}


def schema(family: str, version: str) -> str:
    return f"https://developer.microsoft.com/json-schemas/fabric/item/report/definition/{family}/{version}/schema.json"


SALES = """table Sales
\tlineageTag: 1

\tmeasure Total = SUM(Sales[Amount])
\t\tformatString: 0

\tmeasure 'Total LY' =
\t\t\tCALCULATE(
\t\t\t    [Total], // Sales[NotThis]
\t\t\t    USERELATIONSHIP(Sales[ShipDate], 'Calendar'[Date])
\t\t\t)
\t\tformatString: 0

\tmeasure Orphan = [Helper] + [Ghost]

\tmeasure Helper = COUNTROWS(Sales)

\tmeasure Rate = ```
\t\t\tTaxRate(Sales[Cost])
\t\t\t```

\tcolumn Amount
\t\tdataType: decimal
\t\tsourceColumn: Amt

\tcolumn Cost
\t\tdataType: decimal

\tcolumn ShipDate
\t\tdataType: dateTime

\tcolumn OrderDate
\t\tdataType: dateTime
\t\tisHidden

\tcolumn Region
\t\tdataType: string
\t\tsortByColumn: 'Region Order'

\tcolumn 'Region Order'
\t\tdataType: int64

\tcolumn Broken
\t\tsortByColumn: Nowhere

\tcolumn Double = Sales[Amount] * 2

\thierarchy Geo
\t\tlevel Region
\t\t\tcolumn: Region

\tpartition Sales = m
\t\tmode: import
\t\tsource =
\t\t\t\tlet
\t\t\t\t    Source = Staging,
\t\t\t\t    Renamed = Table.RenameColumns(Source, {{"amt", "Amount"}}),
\t\t\t\t    F = File.Contents("C:\\\\data\\\\x.csv")
\t\t\t\tin
\t\t\t\t    Renamed
"""

CALENDAR = """table Calendar
\tcolumn Date
\t\tdataType: dateTime
\tcolumn Unused
\t\tdataType: int64
\tpartition Calendar = m
\t\tsource = let a = #"Sales" in Table.SelectColumns(Sales, {"Amount"})
"""

AUTO = """table LocalDateTable_1
\tisHidden
\tcolumn Date
\t\tdataType: dateTime
\tannotation __PBI_LocalDateTable = true
"""

EMPTY = """table EmptyTable
\tlineageTag: z
"""

PARAM = """table Picker
\tcolumn 'Picker Fields'
\t\tisHidden
\tcolumn Picker
\tpartition Picker = calculated
\t\tmode: import
\t\tsource =
\t\t\t\t{
\t\t\t\t    ("Total", NAMEOF('Sales'[Total]), 0),
\t\t\t\t    ("Gone", NAMEOF('Sales'[Vanished]), 1)
\t\t\t\t}
"""

CALC = """table Time
\tcalculationGroup
\t\tprecedence: 1
\t\tcalculationItem Now = SELECTEDMEASURE()
\t\t\tordinal: 0
\t\tcalculationItem Late = CALCULATE(SELECTEDMEASURE(), 'Calendar'[Date])
\tcolumn Name
\t\tdataType: string
"""

RELATIONSHIPS = """relationship r1
\tfromColumn: Sales.OrderDate
\ttoColumn: Calendar.Date

relationship r2
\tisActive: false
\tcrossFilteringBehavior: bothDirections
\tfromColumn: Sales.ShipDate
\ttoColumn: 'Calendar'.Date

relationship r3
\tfromCardinality: many
\ttoCardinality: many
\tfromColumn: Sales.Missing
\ttoColumn: Calendar.Date

relationship r4
\tisActive: false
\tfromColumn: Sales.Amount
\ttoColumn: Calendar.Unused
"""

ROLE = """role Managers
\tmodelPermission: read
\ttablePermission Sales = [Region] = "North"
\ttablePermission Ghost = TRUE()
\ttablePermission Calendar
\t\tcolumnPermission Unused = none
"""

PERSPECTIVE = """perspective View
\tperspectiveTable Sales
\t\tperspectiveColumn Cost
\t\tperspectiveMeasure NoSuch
\t\tperspectiveHierarchy Geo
\tperspectiveTable Nope
\t\tincludeAll: true
"""

FUNCTIONS = """function TaxRate = (Sales : NUMERIC, x) => Sales * Calendar[Date]

function Idle = () => Sales[Double]
"""

EXPRESSIONS = """expression Staging =
\t\tlet
\t\t    Source = Sql.Database("srv", "db")
\t\tin
\t\t    Source
\tlineageTag: q

expression Lonely = 1 meta [IsParameterQuery=true]

expression Shady = Expression.Evaluate("x", #shared)
"""


def visual(name: str, visual_type: str, tab: int | None, extra: dict | None = None, refs: dict | None = None, objects: dict | None = None,
           group: str | None = None) -> dict:
    doc = {"$schema": schema("visualContainer", "2.11.0"), "name": name,
           "position": {"x": 10, "y": 10, "width": 100, "height": 50, **({} if tab is None else {"tabOrder": tab})},
           "visual": {"visualType": visual_type, "visualContainerObjects": extra or {}, "objects": objects or {}}}
    if refs:
        doc["visual"]["query"] = {"queryState": refs}
    if group:
        doc["parentGroupName"] = group
    return doc


def projection(*fields: tuple[dict, str]) -> dict:
    return {"projections": [{"field": f, "queryRef": q} for f, q in fields]}


ALT = {"general": [{"properties": {"altText": lit("'what it shows'")}}]}


def _report() -> dict[str, object]:
    base = "Main.Report/definition"
    page1 = f"{base}/pages/p1"
    stale = {"dataPoint": [{"properties": {"fill": {"solid": {"color": lit("'#ff0000'")}}},
                            "selector": {"data": [{"scopeId": {"Comparison": {"Left": col("Sales", "Cost")}}}]}}]}
    files: dict[str, object] = {
        "Main.pbip": "{}",
        "Main.Report/definition.pbir": {"$schema": "https://developer.microsoft.com/json-schemas/fabric/item/report/definitionProperties/2.0.0/schema.json",
                                        "datasetReference": {"byPath": {"path": "../Model.SemanticModel"}}},
        f"{base}/report.json": {
            "$schema": schema("report", "9.9.9"),
            "themeCollection": {"baseTheme": {"name": "B", "type": "SharedResources"}, "customTheme": {"name": "C.json", "type": "RegisteredResources"}},
            "resourcePackages": [{"name": "SharedResources", "type": "SharedResources", "items": [{"name": "B", "path": "B.json", "type": "BaseTheme"}]},
                                 {"name": "RegisteredResources", "type": "RegisteredResources", "items": [{"name": "C.json", "path": "C.json", "type": "CustomTheme"}]}],
            "filterConfig": {"filters": [{"name": "rf", "field": col("sales", "REGION"), "type": "Categorical"}]}},
        "Main.Report/StaticResources/SharedResources/B.json": {
            "name": "Base", "dataColors": ["#111111", "#222222"], "background": "#fff",
            "visualStyles": {"columnChart": {"*": {"title": [{"fontSize": 12, "fontColor": {"solid": {"color": "#abcdef"}}}]}}}},
        f"{base}/pages/pages.json": {"$schema": schema("pagesMetadata", "1.1.0"), "pageOrder": ["p1", "p2"], "activePageName": "p1", "landingPageName": "gone"},
        f"{page1}/page.json": {
            "$schema": schema("visualContainer", "2.1.0"), "name": "p1", "displayName": "First", "width": 1280, "height": 720,
            "visualInteractions": [{"source": "v1", "target": "g1", "type": "NoFilter"}, {"source": "v1", "target": "vX", "type": "DataFilter"}],
            "filterConfig": {"filters": [{"name": "pf", "field": col("Sales", "Vanished")}]}},
        f"{page1}/visuals/v1/visual.json": visual(
            "v1", "clusteredColumnChart", 1, {**ALT, "title": [{"properties": {"text": lit("'It''s sales'"), "fontSize": lit("14D")}}]},
            {"Category": projection((col("Sales", "Region"), "Sales.Region")), "Y": projection((measure("Sales", "Total LY"), "Sales.Total LY"))}, stale),
        f"{page1}/visuals/v2/visual.json": visual(
            "v2", "actionButton", 1, {"visualLink": [{"properties": {"type": lit("'Bookmark'"), "bookmark": lit("'bmX'"), "show": lit("true")}}]}),
        f"{page1}/visuals/v3/visual.json": visual(
            "v3", "card", -1, {"visualTooltip": [{"properties": {"section": lit("'p2'"), "type": lit("'Canvas'")}}],
                               "visualLink": [{"properties": {"type": {"expr": {"Measure": 1}}, "show": {"expr": {"Conditional": {}}}}}]}),
        f"{page1}/visuals/v4/visual.json": visual("v4", "qnaVisual", None, {}, {"X": projection((col("Sales", "Imaginary"), "q"))}),
        f"{page1}/visuals/v5/visual.json": visual("v5", "tableEx", 3, {"title": [{"properties": {"show": lit("false")}}], **ALT},
                                                  {"Values": projection((measure("Ext", "My Measure"), "e"))}, group="g1"),
        f"{page1}/visuals/v6/visual.json": visual("v6", "slicer", 3, ALT, {"Values": projection((
            {"HierarchyLevel": {"Expression": {"Hierarchy": {"Expression": {"PropertyVariationSource": {
                "Expression": {"SourceRef": {"Source": "s"}}, "Name": "Variation", "Property": "OrderDate"}}, "Hierarchy": "H"}}, "Level": "Year"}}, "h"))}, group="g1"),
        f"{page1}/visuals/v6/mobile.json": {"$schema": schema("visualContainerMobileState", "2.7.0"),
                                            "objects": {"x": [{"properties": {"a": measure("Sales", "Rate")}}]}},
        f"{page1}/visuals/g1/visual.json": {"name": "g1", "position": {"tabOrder": 5}, "visualGroup": {"displayName": "Group", "groupMode": "ScaleMode"}},
        f"{page1}/visuals/v7/visual.json": visual("v7", "card", 4, ALT, group="nogroup"),
        f"{base}/pages/p2/page.json": {
            "name": "p2", "displayName": "Second", "type": "Drillthrough", "visibility": "HiddenInViewMode",
            "pageBinding": {"name": "pb", "type": "Drillthrough", "parameters": [{"name": "a", "boundFilter": "f1"}, {"name": "b"}, {"name": "c", "boundFilter": "fX"}]},
            "filterConfig": {"filters": [{"name": "f1", "field": {"HierarchyLevel": {
                "Expression": {"Hierarchy": {"Expression": {"SourceRef": {"Entity": "Sales"}}, "Hierarchy": "Geo"}}, "Level": "Region"}}}]}},
        f"{base}/bookmarks/bookmarks.json": {"items": [{"name": "bm1"}, {"name": "grp", "children": ["bm2", "lost"]}]},
        f"{base}/bookmarks/bm1.bookmark.json": {"name": "bm1", "displayName": "One", "explorationState": {
            "activeSection": "p1", "sections": {"p1": {"visualContainers": {"v2": {}}}}}, "options": {"targetVisualNames": ["v1", "vGone", "g1"]}},
        f"{base}/bookmarks/bm2.bookmark.json": {"name": "bm2", "explorationState": {"activeSection": "pX"}},
        f"{base}/bookmarks/bm3.bookmark.json": {"name": "bm3"},
        f"{base}/reportExtensions.json": {"name": "ext", "entities": [{"name": "Ext", "measures": [
            {"name": "My Measure", "dataType": "Double", "expression": "[x]", "references": {"measures": [
                {"entity": "Sales", "name": "Helper"}, {"schema": "ext", "entity": "Ext", "name": "Nope"}]}}, {"name": "incomplete"}]}]},
        f"{base}/broken.json": "{oops",
    }
    files[f"{page1}/visuals/v6/visual.json"]["visual"]["prototypeQuery"] = {"From": [{"Name": "s", "Entity": "Sales"}]}
    return files


def _model(root: str = "Model.SemanticModel") -> dict[str, object]:
    d = f"{root}/definition"
    return {
        f"{root}/definition.pbism": "{}", f"{d}/model.tmdl": "model Model\n", f"{d}/odd.tmdl": "x",
        f"{d}/tables/Sales.tmdl": SALES, f"{d}/tables/Calendar.tmdl": CALENDAR, f"{d}/tables/Auto.tmdl": AUTO, f"{d}/tables/Empty.tmdl": EMPTY,
        f"{d}/tables/Picker.tmdl": PARAM, f"{d}/tables/Time.tmdl": CALC, f"{d}/relationships.tmdl": RELATIONSHIPS, f"{d}/roles/Managers.tmdl": ROLE,
        f"{d}/perspectives/View.tmdl": PERSPECTIVE, f"{d}/functions.tmdl": FUNCTIONS, f"{d}/expressions.tmdl": EXPRESSIONS,
    }


def second_project() -> dict[str, object]:
    """Same names as the first project: nothing may leak between the two."""
    return {
        "Two.pbip": "{}", "Main.Report/definition.pbir": {"datasetReference": {"byPath": {"path": "../Absent.SemanticModel"}}},
        "Main.Report/definition/pages/pages.json": {"pageOrder": []},
        "Model.SemanticModel/definition/tables/Sales.tmdl": "table Sales\n\tcolumn Amount\n\tcolumn Region\n\tmeasure Total = SUM(Sales[Amount])\n",
    }


def rejected_project() -> dict[str, object]:
    return {"Old.pbip": "{}", "Old.SemanticModel/model.bim": "{}", "Old.SemanticModel/definition/model.tmdl": "x"}


PROJECTS = {"one": {**_report(), **_model()}, "two": second_project(), "old": rejected_project()}


def estate_files(spark, projects: dict[str, dict[str, object]] = PROJECTS):
    rows = []
    for project, files in projects.items():
        for path, value in files.items():
            data = (value if isinstance(value, str) else _doc(value)).encode()
            rows.append((project, path, len(data), bytearray(data)))
    return spark.createDataFrame(rows, "project string, rel_path string, length bigint, content binary").repartition(4)
