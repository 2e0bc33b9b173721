"""Registered queries; importing a module of this package registers what it defines."""
