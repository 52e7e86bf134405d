"""driftloom.operators"""
