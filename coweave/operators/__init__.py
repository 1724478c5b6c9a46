"""DataFrame operators: papers, projects, events, people, grants, linkage, graph measures, viewer and checks."""
