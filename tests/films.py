"""A few films and people as datoms, and two sports players with seasons."""

import datetime as dt

PEOPLE = {101: ("James Cameron", "1954-08-16"), 102: ("Arnold Schwarzenegger", "1947-07-30"), 103: ("Linda Hamilton", "1956-09-26"), 104: ("Paul Verhoeven", "1938-07-18"), 105: ("Peter Weller", "1947-06-24"), 106: ("Danny Glover", "1946-07-22"), 107: ("Mel Gibson", "1956-01-03"), 108: ("Richard Donner", "1930-04-24"), 109: ("Nobody Dated", None)}
FILMS = {1: ("The Terminator", 1984, [101], [102, 103]), 2: ("Terminator 2", 1991, [101], [102, 103]), 3: ("RoboCop", 1987, [104], [105]), 4: ("Lethal Weapon", 1987, [108], [106, 107]), 5: ("Predator 2", 1990, [109], [106]), 6: ("Total Recall", 1990, [104], [102])}
SEQUELS = {1: 2}
SCHEMA = {"movie/title": "string", "movie/year": "long", "movie/director": "long", "movie/cast": "long", "movie/sequel": "long", "person/name": "string", "person/born": "timestamp_ntz"}
#: player, name, then (season entity, year, hits, home runs)
SEASONS = {201: ("Player One", [(301, 1920, 170, 54), (302, 1921, 204, 59)]), 202: ("Player Two", [(303, 1941, 185, 37)])}
SEASON_SCHEMA = {"player/name": "string", "season/player": "long", "season/year": "long", "season/hits": "long", "season/home-runs": "long"}


def film_datoms() -> list[tuple]:
    out = []
    for e, (name, born) in PEOPLE.items():
        out += [(e, "person/name", name)] + ([(e, "person/born", dt.datetime.fromisoformat(born))] if born else [])
    for e, (title, year, directors, cast) in FILMS.items():
        out += [(e, "movie/title", title), (e, "movie/year", year), *[(e, "movie/director", d) for d in directors], *[(e, "movie/cast", c) for c in cast]]
    return out + [(a, "movie/sequel", b) for a, b in SEQUELS.items()]


def season_datoms() -> list[tuple]:
    out = []
    for player, (name, seasons) in SEASONS.items():
        out.append((player, "player/name", name))
        for e, year, hits, runs in seasons:
            out += [(e, "season/player", player), (e, "season/year", year), (e, "season/hits", hits), (e, "season/home-runs", runs)]
    return out


def catalog(spark, facts, schema):
    from tidelog.sources.catalog import AttributeCatalog
    from tidelog.sources.datoms import attribute, datoms

    log, out = datoms(spark, [(1, facts)]), AttributeCatalog()
    for name, kind in schema.items():
        out.add_datoms(name, attribute(log, name, kind).drop("tx"))
    return out
