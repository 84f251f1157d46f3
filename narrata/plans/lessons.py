"""The query corpus: ten modules of questions over the learner views.

Values stand for what the projected warehouse holds: work W3 and its scenes 44-54 for one sequence, W5 and
27-44 for the other, customers for characters. Top-n questions have a unique key as their last order.
Averages of integers are whole numbers, as the modules define them; averages of scores are rounded.
"""

from __future__ import annotations

from narrata.plans.ask import Ask
from narrata.plans.views import DUEL, TRENCH

C, P, E, S, A, L, I, K = (f"learn_{x} x" for x in ("characters", "event_participants", "events", "scenes", "assets", "locations", "continuity_issues", "claims"))
ANH, TPM = f"WorkCode = '{TRENCH[0]}'", f"WorkCode = '{DUEL[0]}'"
RUN, FIGHT = f"{ANH} AND SceneNumber BETWEEN {TRENCH[1]} AND {TRENCH[2]}", f"{TPM} AND SceneNumber BETWEEN {DUEL[1]} AND {DUEL[2]}"
HERO, FOE = "ParticipantName LIKE '%#%00042%'", "ParticipantName LIKE '%0007_'"
RUN_SCENES, FIGHT_SCENES = Ask(S, "SceneName AS k", RUN), Ask(S, "SceneName AS k", FIGHT)
N = "count(*) AS {}".format


def whole(x: str, name: str) -> str:
    return f"CAST(floor(avg({x})) AS INT) AS {name}"


def score(x: str, name: str) -> str:
    return f"round(avg(CAST({x} AS DOUBLE)), 6) AS {name}"


def total(x: str, name: str) -> str:
    return f"CAST(sum({x}) AS BIGINT) AS {name}"


def ratio(x: str, y: str, name: str) -> str:
    return f"round(CAST({x} AS DOUBLE) / CAST({y} AS DOUBLE), 9) AS {name}"


def names(*columns: str) -> str:
    return "; ".join(f"{c} AS {c}" if " AS " not in c else c for c in columns)


def unless(x: str, y: str, name: str) -> str:
    return f"coalesce({x}, '{y}') AS {name}"


PER_MINUTE = "CASE WHEN DurationSec > 0 THEN round(coalesce(n, 0) * CAST(60 AS DOUBLE) / DurationSec, 9) END AS EventsPerMinute"
BRACKET = "CASE WHEN DurationSec < 60 THEN 'Short (< 1 min)' WHEN DurationSec <= 180 THEN 'Medium (1-3 min)' WHEN DurationSec > 180 THEN 'Long (> 3 min)' ELSE 'Unknown' END"
BEAT = (
    "CASE WHEN SceneName LIKE '%Doors%' THEN 'ACT 1: Arrival' WHEN SceneName LIKE '%Barrier%' OR SceneName LIKE '%Gate%' THEN 'ACT 2: Separation'"
    " WHEN SceneName LIKE '%Chase%' THEN 'ACT 3: Pursuit' WHEN SceneName LIKE '%Last Words%' THEN 'RESOLUTION' ELSE 'Other' END"
)
FIRST_PEOPLE = "JOINED(CASE WHEN p.Importance = 'Primary' THEN p.ParticipantName END | p.ParticipantOrder, p.ParticipantName) AS PrimaryParticipants"
ACT = "count_if(Role = 'Actor') AS AsActor; count_if(Role = 'Target') AS AsTarget"
EVENT_KEY = names("e.EventKey AS EventKey", "e.SceneNumber AS SceneNumber", "e.SceneName AS SceneName", "e.EventNumber AS EventNumber", "e.EventSummary AS EventSummary", "e.EventType AS EventType")
PEOPLE = ("left", "learn_event_participants p", "e.EventKey = p.EventKey")

LESSONS: dict[str, Ask] = {
    # 1: characters
    "L01_1": Ask(C, order="CharacterName, CharacterKey", limit=10),
    "L01_2": Ask(C, names("CharacterName", "Species", "Gender", "RoleArchetype", "Homeworld"), "Species = 'Machinery'", order="CharacterName"),
    "L01_3": Ask(C, names("RoleArchetype"), "RoleArchetype IS NOT NULL", distinct=True, order="RoleArchetype"),
    "L01_4": Ask(C, names("CharacterName", "Species", "Homeworld"), "RoleArchetype = 'Villain'", order="CharacterName"),
    "L01_5": Ask(C, names("CharacterName", "Species", "RoleArchetype", "BirthYear"), "Homeworld = 'World 7'", order="CharacterName"),
    "L01_6": Ask(C, names("CharacterName", "Species", "RoleArchetype", "Homeworld"), "CharacterName LIKE '%00012%'", order="CharacterName"),
    "L01_6v": Ask(C, names("CharacterName", "Species"), "CharacterName LIKE 'Customer#00000_01_'", order="CharacterName"),
    "L01_7": Ask(C, names("CharacterName", "EyeColor", "Species", "RoleArchetype"), "EyeColor LIKE '%Blue%'", order="CharacterName, CharacterKey", limit=5),
    "L01_8": Ask(C, names("CharacterName", "Species", "Gender", "RoleArchetype"), "Gender = 'Female' AND Species <> 'Building' AND Species IS NOT NULL", order="Species, CharacterName"),
    "L01_9": Ask(C, names("CharacterName", "BirthYear", "Species", "Homeworld"), "IsCanonical AND BirthYear IS NOT NULL", order="BirthYear, CharacterName"),
    "L01_10": Ask(C, names("CharacterName", unless("Species", "Unknown", "Species"), unless("Homeworld", "Unknown", "Homeworld"), unless("RoleArchetype", "Unclassified", "Archetype")), order="CharacterName, CharacterKey", limit=10),
    "L01_10v": Ask(C, names("CharacterName", "concat(CharacterName, ' of ', coalesce(Homeworld, 'nowhere')) AS Introduction"), order="CharacterName, CharacterKey", limit=10),
    # 2: appearances
    "L02_1": Ask(P, order="WorkTitle, SceneName, EventNumber, ParticipantId", limit=10),
    "L02_2": Ask(P, names("WorkTitle", "SceneName", "EventSummary", "Role", "Importance"), HERO, order="WorkTitle, EventNumber"),
    "L02_3": Ask(P, N("ParticipationCount"), by=names("WorkTitle"), order="ParticipationCount DESC"),
    "L02_4": Ask(P, names("ParticipantName", "ParticipantType"), "Importance = 'Primary' AND WorkTitle LIKE '%TION_3'", distinct=True, order="ParticipantName"),
    "L02_5": Ask(S, names("SceneNumber", "SceneName", "SceneType", "DurationSec", "StartSec", "EndSec"), ANH, order="SceneNumber"),
    "L02_6": Ask(S, names("WorkTitle", "SceneName", "SceneNumber", "DurationSec", "LocationHint"), "SceneType = 'Action'", order="WorkTitle, SceneNumber"),
    "L02_7": Ask(S, names("WorkTitle", "SceneName", "SceneType", "DurationSec", "LocationHint"), "DurationSec IS NOT NULL", order="DurationSec DESC, SceneKey", limit=10),
    "L02_8": Ask(P, names("Role"), "Role IS NOT NULL", distinct=True, order="Role"),
    "L02_9": Ask(P, names("SceneName", "EventSummary", "WorkTitle", "Role", "Importance"), f"{FOE} AND Role = 'Actor'", order="WorkTitle, EventNumber"),
    "L02_10": Ask(P, N("ParticipantCount"), by=names("EventSummary", "WorkTitle", "SceneName"), having="ParticipantCount >= 3", order="ParticipantCount DESC, EventSummary"),
    # 3: events
    "L03_1": Ask(E, order="WorkCode, SceneNumber, EventNumber, EventKey", limit=20),
    "L03_2": Ask(E, names("EventType"), "EventType IS NOT NULL", distinct=True, order="EventType"),
    "L03_3": Ask(E, names("EventSummary", "EventType", "ConfidenceScore", "WorkTitle", "SceneName"), "ConfidenceScore >= 0.90", order="ConfidenceScore DESC, EventSummary, EventKey", limit=20),
    "L03_4": Ask(E, names("SceneNumber", "SceneName", "EventNumber", "EventSummary", "EventType", "Location"), ANH, order="SceneNumber, EventNumber"),
    "L03_5": Ask(E, names("SceneNumber", "SceneName", "EventNumber", "EventSummary", "EventType", "ConfidenceScore"), RUN, order="SceneNumber, EventNumber"),
    "L03_6": Ask(E, names("WorkTitle", "SceneName", "EventSummary", "EventType", "Location"), "EventType LIKE '%Combat%' OR EventType LIKE '%Attack%'", order="WorkTitle, SceneNumber, EventNumber"),
    "L03_7": Ask(E, names("WorkTitle", "SceneName", "Location", "EventSummary", "EventType"), "Location IS NOT NULL", order="Location, WorkTitle, SceneNumber, EventKey", limit=20),
    "L03_8": Ask(E, names("EventSummary", "ConfidenceScore", "ExtractionMethod", "WorkTitle", "SceneName"), "ConfidenceScore < 0.70", order="ConfidenceScore, WorkTitle"),
    "L03_9": Ask(E, N("EventCount"), by=names("WorkTitle", "WorkCode"), order="EventCount DESC"),
    "L03_10": Ask(E, f"{N('EventCount')}; {score('ConfidenceScore', 'AvgConfidence')}", ANH, by=names("EventType"), order="EventCount DESC"),
    # 4: interactions
    "L04_1": Ask(P, N("EventCount"), by=names("ParticipantName", "ParticipantType"), order="EventCount DESC, ParticipantName, ParticipantType", limit=20),
    "L04_2": Ask(P, N("RoleCount"), by=names("ParticipantName", "Role"), order="ParticipantName, RoleCount DESC"),
    "L04_3": Ask(P, "count(DISTINCT ParticipantName) AS ParticipantCount", by=names("EventSummary", "WorkTitle", "SceneName"), order="ParticipantCount DESC, EventSummary, WorkTitle, SceneName", limit=10),
    "L04_4": Ask(P, N("PrimaryActorCount"), "Importance = 'Primary' AND Role = 'Actor'", by=names("ParticipantName"), order="PrimaryActorCount DESC"),
    "L04_5": Ask(P, "count(DISTINCT ParticipantName) AS ParticipantCount", by=names("WorkTitle", "SceneName"), having="ParticipantCount >= 3", order="ParticipantCount DESC, WorkTitle, SceneName"),
    "L04_6": Ask(P, f"{N('EventCount')}; count(DISTINCT WorkTitle) AS WorkCount", f"{FOE} OR ParticipantName LIKE '%00099%' OR ParticipantName LIKE '%00013%'", by=names("ParticipantName"), order="EventCount DESC"),
    "L04_7": Ask(P, N("TargetCount"), "Role = 'Target'", by=names("ParticipantName", "ParticipantType"), order="TargetCount DESC"),
    "L04_8": Ask(P, f"count(DISTINCT WorkTitle) AS WorkCount; {N('TotalAppearances')}", by=names("ParticipantName"), having="WorkCount >= 2", order="WorkCount DESC, TotalAppearances DESC"),
    "L04_9": Ask(P, f"count(DISTINCT SceneName) AS SceneCount; {N('EventCount')}", by=names("ParticipantName"), order="SceneCount DESC"),
    "L04_10": Ask(P, N("SharedEventCount"), f"NOT ({HERO})", by=names("ParticipantName", "ParticipantType"), among=("EventId", Ask(P, "EventId AS k", HERO)), order="SharedEventCount DESC"),
    # 5: assets
    "L05_1": Ask(A, order="AssetType, AssetName, TechInstanceKey", limit=20),
    "L05_2": Ask(A, N("AssetCount"), by=names("AssetType"), order="AssetCount DESC"),
    "L05_3": Ask(A, names("AssetName", "ModelName", "Manufacturer", "Status", "LastKnownLocation"), "AssetType = 'Ship'", order="AssetName"),
    "L05_4": Ask(A, N("InstanceCount"), "AssetType = 'Droid'", by=names("ModelName"), order="InstanceCount DESC, ModelName"),
    "L05_5": Ask(A, N("AssetCount"), by=unless("x.Status", "Unknown", "Status"), order="AssetCount DESC"),
    "L05_6": Ask(A, names("AssetName", "ModelName", "Manufacturer", "Status"), "AssetType = 'Ship' AND AssetName <> ModelName", order="AssetName"),
    "L05_7": Ask(A, f"{N('AssetCount')}; count(DISTINCT AssetType) AS AssetTypesProduced", by=unless("x.Manufacturer", "Unknown", "Manufacturer"), order="AssetCount DESC"),
    "L05_8": Ask(A, names("AssetName", "ModelName", "Status", "Manufacturer", "SerialNumber"), "AssetType = 'Weapon'", order="ModelName, AssetName"),
    "L05_9": Ask(A, names("AssetName", "AssetType", "ModelName", "LastKnownLocation", "Manufacturer"), "Status = 'Destroyed'", order="AssetType, AssetName"),
    "L05_10": Ask(
        A,
        f"{N('TotalAssets')}; count_if(Status = 'Operational') AS Operational; count_if(Status = 'Destroyed') AS Destroyed; count_if(Status = 'Damaged') AS Damaged;"
        " count_if(Status IS NULL OR Status NOT IN ('Operational', 'Destroyed', 'Damaged')) AS Other",
        by=names("AssetType"),
        order="TotalAssets DESC",
    ),
    # 6: locations
    "L06_1": Ask(L, order="LocationType, LocationName, LocationKey", limit=20),
    "L06_2": Ask(L, N("LocationCount"), by="LocationType AS LocationType; CASE LocationType WHEN 'Galaxy' THEN 1 WHEN 'Region' THEN 2 WHEN 'System' THEN 3 WHEN 'Planet' THEN 4 WHEN 'Site' THEN 5 ELSE 6 END AS TypeRank", order="TypeRank"),
    "L06_3": Ask(L, names("LocationName", "LocationType", "Description"), "ParentLocation IS NULL", order="LocationType, LocationName"),
    "L06_4": Ask(L, names("LocationName", "ParentLocation", "Climate", "Terrain", "Population"), "LocationType = 'Planet'", order="LocationName"),
    "L06_5": Ask(L, names("LocationName", "LocationType", "Description"), "LocationType = 'Site' AND ParentLocation = 'NATION_7'", order="LocationName"),
    "L06_6": Ask(L, names("LocationName", "LocationType", "Climate", "Terrain"), "Climate IS NOT NULL", order="LocationType, LocationName"),
    "L06_7": Ask(L, names("LocationName", "LocationType", "Terrain", "Climate"), "lower(Terrain) LIKE '%desert%'", order="LocationName"),
    "L06_8": Ask(L, f"count_if(ParentLocation IS NULL) AS RootNodes; count_if(ParentLocation IS NOT NULL) AS ChildNodes; {N('TotalCount')}", by=names("LocationType"), order="TotalCount DESC"),
    "L06_9": Ask(L, names("LocationName", "LocationType", "Population", "Government"), "Population IS NOT NULL", order="LocationType, LocationName"),
    "L06_10": Ask(L, f"{N('ChildCount')}; JOINED(LocationName | LocationName) AS Children", "ParentLocation IS NOT NULL", by=unless("ParentLocation", "(No Parent)", "Parent"), order="ChildCount DESC"),
    "L06_10b": Ask(L, N("ChildCount"), by=unless("ParentLocation", "(No Parent)", "Parent"), order="ChildCount DESC"),
    # 7: scenes
    "L07_1": Ask(S, f"{N('SceneCount')}; {total('DurationSec', 'TotalDurationSec')}; {whole('DurationSec', 'AvgDurationSec')}; min(DurationSec) AS MinDurationSec; max(DurationSec) AS MaxDurationSec", "DurationSec IS NOT NULL", by=names("WorkTitle", "WorkCode"), order="TotalDurationSec DESC"),
    "L07_2": Ask(S, f"{N('SceneCount')}; {whole('DurationSec', 'AvgDurationSec')}", by=names("SceneType"), order="SceneCount DESC"),
    "L07_3": Ask(S, "max(DurationSec) AS MaxDurationSec", "DurationSec IS NOT NULL", by=names("WorkTitle"), order="MaxDurationSec DESC"),
    "L07_3b": Ask(S, names("x.WorkTitle AS WorkTitle", "SceneName", "DurationSec"), joins=(("inner", (Ask(S, "max(DurationSec) AS m", by="WorkTitle AS Work"), "y"), "x.WorkTitle = y.Work AND x.DurationSec = y.m"),), order="DurationSec DESC"),
    "L07_4": Ask(S, names("SceneName", "SceneNumber", "StartSec", "EndSec", "DurationSec", ratio("StartSec * 100", "$end", "PercentThroughFilm")), ANH, one={"end": Ask(S, "max(EndSec) AS m", ANH)}, order="SceneNumber"),
    "L07_5": Ask(E, N("EventCount"), ANH, by=names("SceneName", "SceneNumber"), order="EventCount DESC, SceneName, SceneNumber", limit=20),
    "L07_6": Ask(S, "count(e.EventId) AS EventCount", "SceneType = 'Action'", by=names("x.WorkTitle AS WorkTitle", "x.SceneName AS SceneName", "x.DurationSec AS DurationSec"), joins=(("left", "learn_events e", "x.SceneKey = e.SceneKey"),), order="EventCount DESC"),
    "L07_7": Ask(S, f"{N('SceneCount')}; {whole('DurationSec', 'AvgDuration')}", by=f"{BRACKET} AS DurationBracket", order="AvgDuration"),
    "L07_8": Ask(S, f"{N('SceneCount')}; {whole('DurationSec', 'AvgDurationSec')}; min(DurationSec) AS MinDurationSec; max(DurationSec) AS MaxDurationSec", "SceneType IN ('Opening', 'Ending', 'Credits')", by=names("SceneType"), order="SceneType"),
    "L07_9": Ask(S, f"{N('SceneCount')}; {total('DurationSec', 'TotalSeconds')}; {ratio('sum(DurationSec)', '60', 'TotalMinutes')}; {ratio('sum(DurationSec)', '3600', 'TotalHours')}", "DurationSec IS NOT NULL", by=names("WorkTitle", "WorkCode"), order="TotalMinutes DESC"),
    "L07_10": Ask(S, names("SceneNumber", "SceneName", "SceneType", "DurationSec", "coalesce(n, 0) AS EventCount", PER_MINUTE), ANH, joins=(("left", (Ask(E, "count(*) AS n", by="SceneKey AS k"), "y"), "x.SceneKey = y.k"),), order="SceneNumber"),
    # 8: continuity
    "L08_1": Ask(I, order="SeverityScore DESC, IssueSummary, ContinuityIssueKey", limit=20),
    "L08_2": Ask(I, f"{N('IssueCount')}; {whole('SeverityScore', 'AvgScore')}", by=names("Severity"), order="AvgScore DESC"),
    "L08_3": Ask(I, names("IssueSummary", "IssueType", "Severity", "SeverityScore", "DisputeLevel", "Status"), "Severity IN ('High', 'Critical')", order="SeverityScore DESC, DisputeLevel DESC"),
    "L08_4": Ask(I, f"{N('IssueCount')}; {ratio('count(*) * 100', '$all', 'PercentOfTotal')}", by=names("Status"), one={"all": Ask(I, "count(*) AS n")}, order="IssueCount DESC"),
    "L08_5": Ask(I, f"{N('IssueCount')}; {whole('SeverityScore', 'AvgSeverity')}", by=f"{unless('WorkTitle', '(Franchise-wide)', 'Work')}; WorkCode AS WorkCode", order="IssueCount DESC"),
    "L08_6": Ask(K, order="SubjectName, Predicate, ClaimKey", limit=20),
    "L08_7": Ask(K, f"{N('ClaimCount')}; {score('ConfidenceScore', 'AvgConfidence')}", by=names("SubjectName", "SubjectType"), order="ClaimCount DESC"),
    "L08_8": Ask(K, names("SubjectName", "Predicate", "Value", "ConfidenceScore", "ExtractionMethod", "SourceWork"), "ConfidenceScore < 0.70", order="ConfidenceScore, SubjectName"),
    "L08_9": Ask(K, f"{N('ClaimCount')}; {score('ConfidenceScore', 'AvgConfidence')}; min(ConfidenceScore) AS MinConfidence; max(ConfidenceScore) AS MaxConfidence", by=names("ClaimType"), order="ClaimCount DESC"),
    "L08_10": Ask(I, names("IssueSummary", "Description", "IssueType", "Severity", "SeverityScore", "DisputeLevel", "Status", "WorkTitle", "SceneName", "ContinuityFrame"), "DisputeLevel = 'High'", order="SeverityScore DESC"),
    # 9: the first sequence
    "L09_1": Ask(S, names("SceneNumber", "SceneName", "SceneType", "DurationSec", "StartSec", "EndSec", "LocationHint"), RUN, order="SceneNumber"),
    "L09_2": Ask(S, f"count(*) AS SceneCount; {total('DurationSec', 'TotalSeconds')}; {ratio('sum(DurationSec)', '60', 'TotalMinutes')}; min(StartSec) AS SequenceStartSec; max(EndSec) AS SequenceEndSec", RUN),
    "L09_3": Ask(E, names("SceneNumber", "SceneName", "EventNumber", "EventSummary", "EventType", "ConfidenceScore"), RUN, order="SceneNumber, EventNumber"),
    "L09_4": Ask(P, names("ParticipantName", "ParticipantType"), ANH, among=("SceneName", RUN_SCENES), distinct=True, order="ParticipantType, ParticipantName"),
    "L09_5": Ask(P, f"{N('EventAppearances')}; count(DISTINCT SceneName) AS SceneAppearances", f"{ANH} AND Importance = 'Primary'", among=("SceneName", RUN_SCENES), by=names("ParticipantName"), order="EventAppearances DESC"),
    "L09_6": Ask(E, f"{N('EventCount')}; {score('ConfidenceScore', 'AvgConfidence')}", RUN, by=names("EventType"), order="EventCount DESC"),
    "L09_7": Ask(E, N("EventCount"), RUN, by=names("SceneNumber", "SceneName"), order="SceneNumber"),
    "L09_8": Ask(
        P,
        names("SceneName", "EventSummary", "Role", "Importance", "EventNumber", "FirstScene"),
        f"{ANH} AND ParticipantName LIKE '%7_'",
        among=("SceneName", RUN_SCENES),
        joins=(("left", (Ask(S, "min(SceneNumber) AS FirstScene", ANH, by="SceneName AS k"), "y"), "x.SceneName = y.k"),),
        order="FirstScene, EventNumber",
    ),
    "L09_9": Ask(E, names("EventNumber", "EventSummary", "EventType", "ConfidenceScore"), f"{ANH} AND SceneNumber = 49", order="EventNumber"),
    "L09_10": Ask("learn_events e", FIRST_PEOPLE, f"e.{RUN}", by=EVENT_KEY, joins=(PEOPLE,), order="SceneNumber, EventNumber"),
    "L09_10b": Ask("learn_events e", names("e.EventKey AS EventKey", "e.SceneNumber AS SceneNumber", "e.EventSummary AS EventSummary", "p.ParticipantName AS ParticipantName"), f"e.{RUN}", joins=((PEOPLE[0], PEOPLE[1], PEOPLE[2] + " AND p.Importance = 'Primary'"),), order="SceneNumber"),
    # 10: the second sequence
    "L10_1": Ask(S, names("SceneNumber", "SceneName", "SceneType", "DurationSec", "StartSec", "EndSec", "LocationHint"), FIGHT, order="SceneNumber"),
    "L10_2": Ask(S, "count(*) AS Value; min('Scenes') AS Metric", FIGHT, also=(Ask(S, f"{total('DurationSec', 'Value')}; min('Duration (sec)') AS Metric", FIGHT), Ask(E, "count(*) AS Value; min('Events') AS Metric", FIGHT))),
    "L10_2b": Ask(S, "count(*) AS Scenes; max($seconds) AS Seconds; max($events) AS Events", FIGHT, one={"seconds": Ask(S, total("DurationSec", "n"), FIGHT), "events": Ask(E, "count(*) AS n", FIGHT)}),
    "L10_3": Ask(P, f"{N('EventAppearances')}; count(DISTINCT SceneName) AS SceneAppearances; {ACT}", f"{TPM} AND ({FOE} OR ParticipantName LIKE '%0001_' OR ParticipantName LIKE '%0004_')", among=("SceneName", FIGHT_SCENES), by=names("ParticipantName"), order="EventAppearances DESC"),
    "L10_4": Ask(S, names("SceneNumber", "SceneName", "DurationSec", "coalesce(n, 0) AS EventCount", PER_MINUTE), FIGHT, joins=(("left", (Ask(E, "count(*) AS n", FIGHT, by="SceneKey AS k"), "y"), "x.SceneKey = y.k"),), order="SceneNumber"),
    "L10_5": Ask(E, names("SceneNumber", "SceneName", "EventNumber", "EventSummary", "EventType", "ConfidenceScore"), f"{FIGHT} AND (EventType LIKE '%Combat%' OR EventType LIKE '%Attack%' OR EventType LIKE '%Duel%')", order="SceneNumber, EventNumber"),
    "L10_6": Ask(S, names("SceneNumber", "SceneName", "SceneType", "DurationSec", "LocationHint"), f"{TPM} AND (SceneName LIKE '%Barrier%' OR SceneName LIKE '%Gate%' OR SceneName LIKE '%Laser%' OR SceneNumber BETWEEN 32 AND 35)", order="SceneNumber"),
    "L10_7": Ask(E, names("SceneName", "EventNumber", "EventSummary", "EventType"), f"{TPM} AND SceneNumber IN (36, 37)", order="SceneNumber, EventNumber"),
    "L10_8": Ask("learn_events e", names("e.SceneNumber AS SceneNumber", "e.SceneName AS SceneName", "e.EventNumber AS EventNumber", "e.EventSummary AS EventSummary", "e.EventType AS EventType", "p.ParticipantName AS ParticipantName", "p.Role AS Role"), f"e.{TPM} AND e.SceneNumber BETWEEN 39 AND 43", joins=((PEOPLE[0], PEOPLE[1], PEOPLE[2] + " AND p.ParticipantName LIKE '%4_'"),), order="e.SceneNumber, e.EventNumber"),
    "L10_9": Ask(S, names("SceneNumber", "SceneName", f"{BEAT} AS NarrativeBeat", "DurationSec"), FIGHT, order="SceneNumber"),
    "L10_10": Ask("learn_events e", FIRST_PEOPLE, f"s.{TPM} AND s.SceneNumber BETWEEN {DUEL[1]} AND {DUEL[2]}", by=EVENT_KEY, joins=(("inner", "learn_scenes s", "s.SceneKey = e.SceneKey"), PEOPLE), order="SceneNumber, EventNumber"),
    "L10_10b": Ask("learn_scenes s", names("s.SceneNumber AS SceneNumber", "s.SceneName AS SceneName", "e.EventNumber AS EventNumber", "e.EventSummary AS EventSummary"), f"s.{TPM} AND s.SceneNumber BETWEEN {DUEL[1]} AND {DUEL[2]}", joins=(("left", "learn_events e", "s.SceneKey = e.SceneKey"),), order="s.SceneNumber, e.EventNumber"),
    # set questions and paging, as in the modules' variations and the operations guide
    "page_of_events": Ask(E, names("EventKey", "EventSummary", "ConfidenceScore"), order="ConfidenceScore DESC, EventKey", limit=25, skip=50),
    "looks_without_scene": Ask("sem_appearance_look a", names("a.LookKey AS LookKey", "a.LookLabel AS LookLabel"), "s.SceneKey IS NULL", joins=(("left", "sem_scene s", "a.SceneKey = s.SceneKey"),)),
}
