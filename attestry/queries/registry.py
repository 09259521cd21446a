"""All registries of the core."""

from attestry.queries import corpus, feeds, measure, problems, reports, scholar, simulation, studies

REGISTRIES = (problems.REG, corpus.REG, measure.REG, scholar.REG, simulation.REG, feeds.REG, studies.REG, reports.REG)
